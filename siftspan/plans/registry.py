"""All registered queries of the retrieval and evaluation operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siftspan.plans import analysis_queries, retrieval_queries
from siftspan.sources.session import modest_batches

MODULES: list = [retrieval_queries, analysis_queries]


def bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query under Arrow batches of modest size, which the session keeps: its rows are computed later."""

    @wraps(query)
    def run(spark, d):
        modest_batches(spark)
        return query(spark, d)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return {name: bounded(query) for name, query in out.items()}


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= m.ORACLE
    return out
