"""Pareto analysis of points (point_id, objective columns)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _signed(points: DataFrame, objectives: list[str], minimise: tuple[str, ...]) -> DataFrame:
    return points.select("point_id", *[(-F.coalesce(o, F.lit(0.0)) if o in minimise else F.coalesce(o, F.lit(0.0))).cast("double").alias(o) for o in objectives])


#: Distinct points of a slab, about, by which the number of slabs is chosen; cells of the grid at most; rows that edges are taken from.
SLAB, CELLS, SAMPLE = 1 << 15, 1 << 18, 1 << 13


def weigh_above(data: np.ndarray, weight: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each row of `asked` the weight of the rows of `data` that are as great in every column, by divide and conquer.

    Rows are split at the middle of the first column: all of the upper data count for the lower questions, with one
    column less, and each half is asked for itself.
    """
    if not len(data) or not len(asked):
        return np.zeros(len(asked), np.int64)
    columns = data.shape[1]
    if columns == 1:
        order = np.argsort(data[:, 0], kind="stable")
        above = np.append(np.cumsum(weight[order][::-1])[::-1], 0)
        return above[np.searchsorted(data[order, 0], asked[:, 0], "left")]
    if len(data) * len(asked) <= 1 << 18:
        hit = np.ones((len(asked), len(data)), bool)
        for k in range(columns):
            hit &= data[None, :, k] >= asked[:, None, k]
        return hit @ weight
    both = np.concatenate([data[:, 0], asked[:, 0]])
    middle = np.partition(both, len(both) // 2)[len(both) // 2]
    up, ask_up = data[:, 0] >= middle, asked[:, 0] >= middle
    if up.all() and ask_up.all():
        if both.max() == middle:  # all are equal in this column
            return weigh_above(data[:, 1:], weight, asked[:, 1:])
        # Half of all are the least value: those above it are the upper half instead.
        up, ask_up = data[:, 0] > middle, asked[:, 0] > middle
    out = np.zeros(len(asked), np.int64)
    out[~ask_up] = weigh_above(data[up][:, 1:], weight[up], asked[~ask_up][:, 1:]) + weigh_above(data[~up], weight[~up], asked[~ask_up])
    out[ask_up] = weigh_above(data[up], weight[up], asked[ask_up])
    return out


def frontier(points: DataFrame, objectives: list[str], minimise: tuple[str, ...] = ()) -> DataFrame:
    """(point_id, n_dominating, is_optimal): a point is optimal if none is as good in all and better in one objective.

    Counts without pairs. Points of equal values are one row with a weight. Each objective is cut into ranges, of which
    ties are split by the other objectives, so that no value fills one. A point that dominates another lies in a higher
    range of every objective, which the grid of the ranges counts, or shares a range with it: the first objective in
    which it does gives the slab that counts the pair, a task's divide and conquer over about SLAB points. A point goes
    to one slab an objective; the grid has CELLS cells at most.
    """
    rows = _signed(points, objectives, minimise)
    d = len(objectives)
    values = rows.groupBy(*objectives).agg(F.count("*").alias("copies"))
    n = values.count()
    ranges = max(1, min(-(-n // SLAB), int(CELLS ** (1 / d) + 1e-9)))
    # Edges from a sample decide where points are counted, not how often.
    some = np.array(sorted(map(tuple, values.select(*objectives).orderBy(F.xxhash64(*objectives)).limit(SAMPLE).collect()))).reshape(-1, d) if ranges > 1 else np.zeros((0, d))
    edges = []
    for j in range(d):
        turned = sorted(map(tuple, np.roll(some, -j, axis=1).tolist()))
        edges.append([turned[len(turned) * k // ranges] for k in range(1, ranges)] if turned else [])

    def place(j: int) -> Column:
        if not edges[j]:
            return F.lit(0)
        names = objectives[j:] + objectives[:j]
        key = F.struct(*[F.col(o).alias(f"c{i}") for i, o in enumerate(names)])
        return F.size(F.filter(F.array(*[F.struct(*[F.lit(v).alias(f"c{i}") for i, v in enumerate(e)]) for e in edges[j]]), lambda e: e <= key))

    placed = values.select(*objectives, "copies", F.array(*[place(j) for j in range(d)]).alias("at"))
    grid = np.zeros((ranges,) * d, np.int64)
    for r in placed.groupBy("at").agg(F.sum("copies").alias("n")).collect():  # a row a cell
        grid[tuple(r["at"])] = r["n"]
    for j in range(d):
        grid = np.flip(np.cumsum(np.flip(grid, j), j), j)
    above = np.zeros((ranges + 1,) * d, np.int64)
    above[(slice(0, ranges),) * d] = grid

    def slab(table: pa.Table) -> pa.Table:
        j = table["slab"][0].as_py()
        v = np.stack([np.asarray(table[o]) for o in objectives], axis=1)
        at, copies = np.asarray(table["at"].combine_chunks().flatten()).reshape(len(v), d), np.asarray(table["copies"])
        # Before the slab's objective a higher range is asked for, from it on values as great.
        data, asked = v.copy(), v.copy()
        data[:, :j], asked[:, :j] = at[:, :j], at[:, :j] + 1
        counts = weigh_above(data, copies, asked)
        if j == 0:
            counts = counts - copies + above[tuple((at + 1).T)]
        return pa.table([table[o] for o in objectives] + [pa.array(counts)], names=[*objectives, "n"])

    parts = placed.select("*", F.explode(F.array(*[F.lit(j) for j in range(d)])).alias("slab")).withColumn("range", F.element_at("at", F.col("slab") + 1))
    schema = ", ".join(f"`{o}` double" for o in objectives) + ", n long"
    counts = parts.groupBy("slab", "range").applyInArrow(slab, schema).groupBy(*objectives).agg(F.sum("n").alias("n_dominating"))
    return rows.join(counts, objectives).select("point_id", "n_dominating", (F.col("n_dominating") == 0).alias("is_optimal"))


def optimal(points: DataFrame, objectives: list[str], minimise: tuple[str, ...] = ()) -> DataFrame:
    """The rows of `points` that are optimal; for two objectives by a sort and running maximum, without any pairs.

    The sort is one of ranges: each has its running maximum, and the best of the ranges before it, one number a range.
    """
    rows = _signed(points, objectives, minimise)
    if len(objectives) == 2:
        a, b = objectives
        best = rows.groupBy(a).agg(F.max(b).alias(b))
        ranged = best.repartitionByRange(F.col(a).desc()).withColumn("_part", F.spark_partition_id())
        ahead = lambda *by: F.max(b).over(W.partitionBy(*by).orderBy(F.col(a).desc()).rowsBetween(W.unboundedPreceding, -1))
        parts = ranged.groupBy("_part").agg(F.max(b).alias("_best"))
        parts = parts.select("_part", F.max("_best").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
        most = F.greatest(ahead("_part"), F.col("_before"))  # of those that are not null
        keep = ranged.join(F.broadcast(parts), "_part").withColumn("_m", most).where(F.col("_m").isNull() | (F.col(b) > F.col("_m"))).select(a, b)
        ids = rows.join(keep, [a, b], "left_semi").select("point_id")
    else:
        ids = frontier(points, objectives, minimise).where("is_optimal").select("point_id")
    return points.join(ids, "point_id", "left_semi")


def _edges(long: DataFrame) -> DataFrame:
    """(point_id, objective, p, n, span) of `long(point_id, objective, v)`: the neighbouring values, null at the ends.

    Each objective is sorted in ranges: a window runs over a range, and what lies beyond its ends comes from the last
    and first row of the ranges beside it, of which there are as many as partitions.
    """
    ranged = long.repartitionByRange("objective", "v", "point_id").select("*", F.spark_partition_id().alias("part"))
    by = W.partitionBy("part", "objective").orderBy("v", "point_id")
    rows = ranged.select("*", F.lag("v").over(by).alias("p"), F.lead("v").over(by).alias("n"))
    ends = ranged.groupBy("objective", "part").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    order = W.partitionBy("objective").orderBy("part")
    whole = W.partitionBy("objective")
    ends = ends.select("objective", "part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"), (F.max("high").over(whole) - F.min("low").over(whole)).alias("span"))
    return rows.join(F.broadcast(ends), ["objective", "part"]).select("point_id", "objective", F.coalesce("p", "before").alias("p"), F.coalesce("n", "after").alias("n"), "span")


def crowding(points: DataFrame, objectives: list[str]) -> DataFrame:
    """(point_id, crowding_distance, is_boundary): per objective the gap between neighbours over the range, summed;
    the first and last of any objective are boundary points, whose distance is null (infinite)."""
    rows = _edges(points.unpivot(["point_id"], objectives, "objective", "v"))
    rows = rows.withColumn("edge", F.col("p").isNull() | F.col("n").isNull()).withColumn("d", F.when(F.col("span") > 1e-10, (F.col("n") - F.col("p")) / F.col("span")).otherwise(0.0))
    out = rows.groupBy("point_id").agg(F.max("edge").alias("is_boundary"), F.sum("d").alias("d"))
    return out.select("point_id", F.when(~F.col("is_boundary"), F.round("d", 6)).alias("crowding_distance"), "is_boundary")


def analyse(points: DataFrame, objectives: list[str], minimise: tuple[str, ...] = ()) -> DataFrame:
    """Every row of `points` with n_dominating, is_optimal, crowding_distance, is_boundary and frontier_rank.

    Crowding is that of the frontier alone. frontier_rank orders the frontier by falling crowding distance, boundary
    points (infinite) first, then by id; dominated points have nulls there and a distance of 0.
    """
    counted = frontier(points, objectives, minimise)
    best = points.join(counted.where("is_optimal").select("point_id"), "point_id", "left_semi")
    crowd = crowding(_signed(best, objectives, minimise), objectives)
    crowd = crowd.withColumn("frontier_rank", F.row_number().over(W.orderBy(F.col("is_boundary").desc(), F.col("crowding_distance").desc(), "point_id")))
    out = points.join(counted, "point_id").join(crowd, "point_id", "left")
    return out.withColumn("crowding_distance", F.when(F.col("is_optimal"), F.col("crowding_distance")).otherwise(0.0))


def suggest(points: DataFrame, weights: dict[str, float] | None, objectives: list[str] | None = None, minimise: tuple[str, ...] = ()) -> DataFrame:
    """One row of the frontier: with weights the largest weighted sum of raw values (`utility`, ties: the smaller id);
    without, the first by crowding distance. `objectives` are those of the weights if not given."""
    objectives = objectives or list(weights or {})
    if weights is None:
        return analyse(points, objectives, minimise).where(F.col("frontier_rank") == 1).select(*points.columns)
    total: Column = reduce(lambda a, b: a + b, [F.coalesce(o, F.lit(0.0)) * w for o, w in weights.items()])
    return optimal(points, objectives, minimise).withColumn("utility", F.round(total, 6)).orderBy(F.col("utility").desc(), "point_id").limit(1)
