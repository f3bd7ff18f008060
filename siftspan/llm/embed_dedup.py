"""Near-duplicate vectors: an exact metric range join by pivots.

Unit vectors are points of a metric space under the angle between them, and cosine >= t is an angle of at most
r = arccos t. Pivots (a sample of the vectors of each length) partition the points: each belongs to the cell of its
nearest pivot. If x lies in cell p and y in cell q with angle(x, y) <= r, then x is within r of the half-space of q, so
x needs a copy in cell q only if

    <x, p - q> / |p - q| <= sin r     (distance to the bisecting great circle), and
    angle(x, q) <= radius(q) + r      (triangle inequality with the farthest member of q),

and cells then join independently (`cells.linked`). Lengths with few vectors are one cell each and need no pivot; one
join has the cells of all lengths. Candidates come from single-precision products with a margin that covers their
rounding; every link is decided by the cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.llm.cells import linked
from siftspan.llm.common import cut, tidy

#: Rows of a block; vectors to a pivot; pivots at most (they are sent to every task: 4096 of 64 doubles are 2 MB).
BLOCK, PER_PIVOT, MAX_PIVOTS = 16384, 32768, 4096
MARGIN = 1e-4


def matrix(column: Iterable) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    return np.stack([np.asarray(v, np.float64) for v in column])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which rounds nothing, so that their largest components are about one and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of vectors that can have a cosine: not null or empty, no null or non-finite component, not zero.

    Single-precision vectors stay as they are, which halves what moves; others are doubles.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link where their cosine is `threshold` or more (0 < threshold <= 1). Null, empty or zero vectors and those
    with null or non-finite components link with nothing: n_links 0, their own component, kept. Vectors of other
    lengths than another are never compared with it. Equal vectors are one row in the join, with how many there are;
    rows that repeat an id are vectors of their own that share it. A null id links like any other and has a null
    component only if it is alone. Empty tables give no rows; other columns are ignored.
    """
    good = usable(vectors, id_col, vector_col)
    # Numbers instead of hashes, so that no two vectors share one; they are those of this table from here on.
    classes, _ = cut(spark, good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    links, member = _join(spark, classes, threshold)
    known = classes.join(links, "id", "left").join(member.withColumnRenamed("node", "id"), "id", "left").select("v", "least", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    known, _ = cut(spark, known, "vector-known")
    named = known.join(known.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("v", "n_links", "component_id")
    ids = F.col(id_col).cast("long")
    every = vectors.select(ids.alias("vec_id"), F.col(vector_col).cast(classes.schema["v"].dataType).alias("v"))
    out = every.join(named, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _finder(threshold: float) -> Callable:
    """`find` of `cells.linked`: rows whose vectors have a cosine of `threshold` or more."""

    def find(a: pa.Table, b: pa.Table):
        if not len(a) or not len(b):
            return
        x, y = (scaled(np.asarray(t.column("v").chunk(0).flatten(), np.float64).reshape(len(t), -1)) for t in (a, b))
        p, q = (unit(z).astype(np.float32) for z in (x, y))
        for at in range(0, len(x), 256):
            i, j = np.nonzero(p[at : at + 256] @ q.T >= threshold - MARGIN)
            for k in range(0, len(i), 1 << 17):
                u, w = i[k : k + (1 << 17)] + at, j[k : k + (1 << 17)]
                ok = cosine(x[u], y[w]) >= threshold
                yield u[ok], w[ok]

    return find


def choose_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """By length, for lengths of more than PER_PIVOT vectors: unit vectors of a sample, about one to PER_PIVOT."""
    d = F.size("v").alias("d")
    sizes = classes.groupBy(d).agg(F.count("*").alias("n")).where(F.col("n") > PER_PIVOT).orderBy(F.desc("n"), "d").limit(MAX_PIVOTS // 2).collect()
    scale = min(1.0, MAX_PIVOTS / 2 / max(1.0, sum(r["n"] / PER_PIVOT for r in sizes)))
    if not sizes:
        return {}
    shares = classes.sparkSession.createDataFrame([(r["d"], max(1.5 / r["n"], scale / PER_PIVOT)) for r in sizes], "d int, share double")
    drawn = F.pmod(F.xxhash64("v"), F.lit(1 << 40)) < F.col("share") * float(1 << 40)
    found: dict[int, list] = {}
    for r in classes.select("v", d).join(F.broadcast(shares), "d").where(drawn).select("v").collect():
        found.setdefault(len(r["v"]), []).append(r["v"])
    return {k: unit(matrix(sorted(map(list, v)))) for k, v in found.items()}


def _join(spark: SparkSession, classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links among distinct vectors: (id, n_links), counting copies, and (node, component).

    Cells with pivots are numbered from 0, pivots of a length together; the others are -length.
    """
    pivots = choose_pivots(classes)
    first, n_pivots = {}, 0
    for d in sorted(pivots):
        first[d] = n_pivots
        n_pivots += len(pivots[d])
    angle = math.acos(min(1.0, threshold))
    reach, sine = angle + 1e-6, math.sin(angle) + 1e-6
    apart = {d: np.maximum(np.sqrt(np.maximum(2 - 2 * p @ p.T, 0)), 1e-9) for d, p in pivots.items()}

    def by_length(batch: pa.RecordBatch):
        """(length, row numbers, products with the pivots) of the rows of each length with pivots; (length, rows, None) else."""
        rows = batch.column("v").to_pylist()
        lengths = np.array([len(v) for v in rows])
        for d in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == d)
            yield d, at, unit(matrix(rows[k] for k in at)) @ pivots[d].T if d in pivots else None

    def far(batches):
        for batch in batches:
            for d, _, x in by_length(batch):
                if x is not None:
                    least = np.full(x.shape[1], 2.0)
                    np.minimum.at(least, x.argmax(axis=1), x.max(axis=1))
                    some = np.flatnonzero(least < 2)
                    yield pa.record_batch([pa.array(some + first[d]), pa.array(least[some])], names=["cell", "cosine"])

    radius = np.full(n_pivots, -1.0)
    if n_pivots:
        for r in classes.select("v").mapInArrow(tidy(far), "cell long, cosine double").groupBy("cell").agg(F.min("cosine").alias("cosine")).collect():
            radius[r["cell"]] = math.acos(max(-1.0, min(1.0, r["cosine"])))

    def place(batches):
        for batch in batches:
            for d, at, x in by_length(batch):
                if x is None:
                    i, cell, own = at, np.full(len(at), -d, np.int64), np.ones(len(at), bool)
                else:
                    row = np.arange(len(at))
                    home = x.argmax(axis=1)
                    near = (x[row, home][:, None] - x) / apart[d][home] <= sine
                    near &= np.arccos(np.clip(x, -1, 1)) <= radius[first[d] : first[d] + x.shape[1]][None, :] + reach
                    near &= np.arange(x.shape[1])[None, :] < home[:, None]
                    near[row, home] = True
                    k, cell = np.nonzero(near)
                    i, own, cell = at[k], home[k] == cell, cell + first[d]
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take), batch.column("copies").take(take), pa.array(own), pa.array(cell)], names=["id", "v", "copies", "home", "cell"])

    kind = classes.schema["v"].dataType.simpleString()
    placed = classes.select("id", "v", "copies").mapInArrow(tidy(place), f"id long, v {kind}, copies long, home boolean, cell long")
    return linked(spark, placed, BLOCK, _finder(threshold), "vectors", weight="copies")
