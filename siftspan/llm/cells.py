"""Range joins by cells: rows that share a cell meet in groups of bounded size, and cells join independently.

Every row has one home cell and may be copied to cells of smaller number, where it is a guest. A pair is compared in
the smaller home cell of the two: home with home, or home with guest; two guests never are. So each pair that the
copying rule can't exclude is compared once.

In a cell, home rows are queries and all rows are targets. Queries and targets are dealt by a hash of their ids to
blocks of about `block` rows, and each pair of a query block and a target block is a group of its own: a group holds
two blocks at most, whatever the cell holds. Most cells have one query block, so that a guest travels once.

Groups return no pairs: for each row the number of its links in the group, and a forest that connects what the group
links. Their sums and the components of all forests are those of the whole link graph.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.llm.common import components, cut

TARGET, QUERY = 1, 2


def spanning(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the labels of linked rows in place: each row ends with the least row number of its component so far."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def linked(spark: SparkSession, rows: DataFrame, block: int, find: Callable[[pa.Table, pa.Table], object], label: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Links of `rows(id long, home boolean, cell long, ...)`: (id, n_links) of rows that have any, (node, component).

    A link counts as many times as the column `weight` of its other end says, once without one. `find(queries,
    targets)` yields arrays (i, j) of row numbers of linked rows of two tables, each of one chunk.
    """
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("h"))
    # As many numbers as cells: the callers bound them by their pivots or their grid.
    split = [(r["cell"], max(1, math.ceil(r["h"] / block)), max(1, math.ceil(r["n"] / block))) for r in counts.where(F.col("n") > block).collect()]
    queries, targets = F.lit(1), F.lit(1)
    if split:
        rows = rows.join(F.broadcast(spark.createDataFrame(split, "cell long, _nq int, _nt int")), "cell", "left")
        queries, targets = F.coalesce("_nq", F.lit(1)), F.coalesce("_nt", F.lit(1))
    q, t = (F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int") for n in (queries, targets))
    copies = F.concat(
        F.transform(F.sequence(F.lit(0), queries - 1), lambda k: F.struct(k.alias("q"), t.alias("t"), F.when(F.col("home") & (k == q), TARGET | QUERY).otherwise(TARGET).alias("role"))),
        F.when(F.col("home"), F.filter(F.transform(F.sequence(F.lit(0), targets - 1), lambda k: F.struct(q.alias("q"), k.alias("t"), F.lit(QUERY).alias("role"))), lambda c: c["t"] != t)).otherwise(F.array().cast("array<struct<q:int,t:int,role:int>>")),
    )
    keep = [c for c in rows.columns if c not in ("_nq", "_nt")]
    dealt = rows.select(*keep, F.explode(copies).alias("c")).select(*keep, "c.*")

    def group(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
        ids, home, role = (table.column(c).to_numpy() for c in ("id", "home", "role"))
        many = table.column(weight).to_numpy() if weight else np.ones(len(ids), np.int64)
        links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        one, two = np.flatnonzero(role & QUERY), np.flatnonzero(role & TARGET)
        for i, j in find(table.take(pa.array(one)).combine_chunks(), table.take(pa.array(two)).combine_chunks()):
            i, j = one[i], two[j]
            new = ~home[j] | (i < j)  # rows are ordered by id, and two home rows are compared from the smaller one
            i, j = i[new], j[new]
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            spanning(labels, i, j)
        out = links > 0
        return pa.table({"id": ids[out], "n": links[out], "root": ids[labels[out]]})

    made = dealt.groupBy("cell", "q", "t").applyInArrow(group, "id long, n long, root long")
    made, _ = cut(spark, made, f"{label}-links")
    return made.groupBy("id").agg(F.sum("n").alias("n_links")), components(spark, made.select(F.col("id").alias("a"), F.col("root").alias("b")), label)
