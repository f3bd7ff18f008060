"""Ranking: scores are rounded before they are compared, and ties go to the smaller document id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def topk(scored: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", score: str = "score", threshold: float = 0.0, ascending: bool = False) -> DataFrame:
    """The k best rows of each query with `rank` from 1. A threshold counts only if it is over 0.

    The filter on row_number lets Spark keep k rows a query in each task before the shuffle (WindowGroupLimit).
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    rows = scored.withColumn(score, F.round(score, 6))
    order = F.col(score).asc() if ascending else F.col(score).desc()
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(order, F.col(doc).asc()))).where(F.col("rank") <= k)
    return ranked.where(F.col(score) >= threshold) if threshold > 0 else ranked


def by_max(scored: DataFrame, query: str = "query_id", score: str = "score") -> DataFrame:
    """Scores over the best score of the query, where that is positive."""
    best = F.max(score).over(W.partitionBy(query))
    return scored.withColumn("_best", best).withColumn(score, F.when(F.col("_best") > 0, F.col(score) / F.col("_best")).otherwise(F.col(score))).drop("_best")
