"""A vector table: (id, vector, metadata) in Parquet segments under one path, with upsert, delete, search and filters.

Every change is a segment of its own: new rows, or marks of deleted ids. A segment counts from when it is written whole,
so readers never see half a change, and a lost executor costs its tasks. What is in the table is what the last change of
each id left; `compact` writes that as a new base and drops the segments before it, and is called by itself once there
are many. A table with one base is read as it is, without a shuffle.
"""

from __future__ import annotations

import json
import random
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspan.functions.vector import normalise
from siftspan.operators import blocks, dense
from siftspan.operators.topk import topk
from siftspan.sources.tables import cut

#: id, vector, metadata, the cell of a clustered table; change: the number of the segment; last: whether it replaces what
#: was there under its id; gone: whether it is a mark of a deletion.
SCHEMA = "id string, vector array<double>, metadata map<string,string>, cell int"
STORED = SCHEMA + ", change long, last boolean, gone boolean"
#: Bits below the number of a change, by which two changes of one number, made at the same time, differ.
BITS = 20


class VectorStore(Protocol):
    """What a store of vectors offers, whatever keeps them: DataFrames in, DataFrames out."""

    def add(self, rows: DataFrame) -> None: ...
    def search(self, queries: DataFrame, k: int = 10, filters: dict[str, str] | None = None) -> DataFrame: ...
    def delete(self, ids: DataFrame) -> None: ...
    def count(self) -> int: ...
    def add_documents(self, docs: DataFrame, vectors: DataFrame) -> None: ...


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """`old` with the rows of `new` in the place of those of equal key; of repeated keys in `new` the last by `order`."""
    if order:
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("_n") == 1).drop("_n")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def where_metadata(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows whose metadata equals all of the filters, compared as text."""
    out = rows
    for name, value in filters.items():
        out = out.where(F.col("metadata")[name] == F.lit(str(value)))
    return out


def train_cells(vectors: DataFrame, nlist: int = 100, seed: int = 42) -> DataFrame:
    """(cell int, c array<double>): the centroids of k-means over `vectors(v)`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=nlist, seed=seed, featuresCol="f", maxIter=10).fit(vectors.select(array_to_vector("v").alias("f")))
    rows = [(k, list(map(float, c))) for k, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell int, c array<double>")


def assign_cells(vectors: DataFrame, centroids: DataFrame, vector: str = "v") -> DataFrame:
    """`vectors` with `cell`: the number of the nearest centroid, the smaller one of equal ones; null for a null vector.

    Centroids, of which there are as many as cells, are sent to the tasks, which multiply them with batches of vectors.
    """
    known = sorted((r["cell"], r["c"]) for r in centroids.collect())
    cells, c = np.array([k for k, _ in known], np.int32), np.array([v for _, v in known], np.float64)

    @F.pandas_udf("int")
    def nearest(v):
        import pandas as pd

        x = np.stack([np.zeros(c.shape[1]) if u is None else np.asarray(u, np.float64) for u in v]) if len(v) else np.zeros((0, c.shape[1]))
        found = cells[((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)]
        return pd.Series(found).where(pd.Series([u is not None for u in v]))

    return vectors.withColumn("cell", nearest(F.col(vector).cast("array<double>")))


def probe(vectors: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10, nprobe: int = 8, metric: str = "cosine") -> DataFrame:
    """Search in the nearest `nprobe` cells alone: `vectors(doc_id, v, cell)`, `centroids(cell, c)`, `queries(query_id, q)`.

    Queries are sent to the vectors with the numbers of their cells, so that each meets the vectors of its cells alone,
    by matrix products; null vectors are in no result.
    """
    spark = vectors.sparkSession
    centers = cut(spark, centroids.select(F.col("cell").alias("doc_id"), F.col("c").alias("v")), "centers")
    near = cut(spark, dense.search(centers, queries, nprobe, metric).select("query_id", F.col("doc_id").alias("cell")), "probed")
    return dense.search(vectors, queries, k, metric, near=near).select("query_id", "doc_id", "score", "rank")


class VectorTable:
    """A table at a path, which is made if it is not there and opened if it is.

    metric: cosine (vectors are stored with unit length), dot or l2. With `nlist`, the table is clustered: the first
    rows that are `nlist` or more train the cells, later ones are assigned to them, and a search looks at the `nprobe`
    nearest cells. metric, dimension and nlist are written with the table; opening it with others is an error.
    """

    #: Segments after the base from which a change compacts the table.
    MOST = 16

    def __init__(self, spark: SparkSession, path: str, metric: str | None = None, dimension: int | None = None, nlist: int | None = None, nprobe: int = 8):
        self.spark, self.path, self.nprobe = spark, path.rstrip("/"), nprobe
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        asked = {"metric": metric, "dimension": dimension, "nlist": nlist}
        about = f"{self.path}/about"
        if self._files.exists(self._path(about)):
            known = json.loads(spark.read.text(about).first()["value"])
            wrong = {k: v for k, v in asked.items() if v is not None and known[k] != v}
            if wrong:
                raise ValueError(f"the table at {self.path} has {known}, not {wrong}")
        else:
            known = asked | {"metric": metric or "cosine"}
            if known["metric"] not in ("cosine", "dot", "l2"):
                raise ValueError(f"no such metric: {metric}")
            spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.text(about)
        self.metric, self.dimension, self.nlist = known["metric"], known["dimension"], known["nlist"]

    def _segments(self) -> list[tuple[int, bool]]:
        """(number, whether it is a base) of the whole segments from the last base on."""
        found = self._files.globStatus(self._path(f"{self.path}/segment-*/_SUCCESS"))
        names = sorted(f.getPath().getParent().getName() for f in found or [])
        parts = [(int(n.split("-")[1]), n.endswith("-base")) for n in names]
        bases = [k for k, (_, base) in enumerate(parts) if base]
        return parts[bases[-1] :] if bases else parts

    def _stored(self, parts: list[tuple[int, bool]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], STORED)
        return blocks.union([self.spark.read.schema(STORED).parquet(self._name(*p)) for p in parts])

    def _name(self, number: int, base: bool) -> str:
        return f"{self.path}/segment-{number:019d}-{'base' if base else 'part'}"

    def _cells(self) -> DataFrame | None:
        where = f"{self.path}/cells"
        return self.spark.read.schema("cell int, c array<double>").parquet(where) if self.nlist and self._files.exists(self._path(f"{where}/_SUCCESS")) else None

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """(id, vector, metadata, cell): what is in the table; with `cells`, of those and of no cell alone.

        A clustered table has a folder a cell in each segment, so the folders of other cells are not read but for the
        ids of later changes, which may hide what is in these.
        """
        parts = self._segments()
        stored = self._stored(parts)
        here = stored if cells is None else stored.where(F.col("cell").isNull() | F.col("cell").isin(cells))
        if all(base for _, base in parts):
            return here.select("id", "vector", "metadata", "cell")
        if cells is not None:
            marks = stored.where("last").groupBy("id").agg(F.max("change").alias("since"))
            return here.join(marks, "id", "left").where((F.col("since").isNull() | (F.col("change") >= F.col("since"))) & ~F.col("gone")).select("id", "vector", "metadata", "cell")
        # The last change that replaces an id hides what was before it.
        since = F.max(F.when(F.col("last"), F.col("change"))).over(W.partitionBy("id"))
        return stored.withColumn("since", since).where((F.col("since").isNull() | (F.col("change") >= F.col("since"))) & ~F.col("gone")).select("id", "vector", "metadata", "cell")

    def _save(self, rows: DataFrame, change: int, base: bool, last: bool, gone: bool) -> None:
        """A segment: an error if there is one of that change, as nothing may be written over."""
        made = rows.select("id", "vector", "metadata", "cell", F.lit(change).cast("long").alias("change"), F.lit(last).alias("last"), F.lit(gone).alias("gone"))
        if self.nlist:  # a cell may hold many of the rows: it is four files
            made.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("cell").parquet(self._name(change, base))
        else:
            made.write.parquet(self._name(change, base))

    def _write(self, rows: DataFrame, last: bool, gone: bool) -> None:
        parts = self._segments()
        number = (parts[-1][0] >> BITS) + 1 if parts else 0
        self._save(rows, (number << BITS) + random.getrandbits(BITS), False, last, gone)
        if len(parts) >= self.MOST:
            self.compact()

    def compact(self) -> None:
        """The rows of the table as one base. Segments before it are deleted: readers of those must have ended.

        The base comes right after the last segment that it holds, so a change that is written meanwhile stays after it.
        """
        parts = self._segments()
        if not parts or (len(parts) == 1 and parts[0][1]):
            return
        self._save(self.rows(), parts[-1][0] + 1, True, False, False)
        for part in parts:
            self._files.delete(self._path(self._name(*part)), True)

    def add(self, rows: DataFrame, mode: str = "upsert", order: str | None = None) -> None:
        """Rows (id, vector, metadata). mode upsert replaces what is there under an id, append keeps it.

        Of rows that repeat an id, upsert takes the last one by the column `order`; without it, the one with the
        greatest metadata as text and vector, so that repeated runs agree.
        """
        if mode not in ("upsert", "append"):
            raise ValueError(f"no such mode: {mode}")
        v = F.col("vector").cast("array<double>")
        new = rows.select(F.col("id").cast("string").alias("id"), v.alias("vector"), F.col("metadata").cast("map<string,string>").alias("metadata"), (F.col(order) if order else F.struct(F.to_json("metadata"), v)).alias("_order"))
        if self.dimension and not new.where(F.size("vector") != self.dimension).isEmpty():
            raise ValueError(f"vectors must have {self.dimension} components")
        if mode == "upsert":
            new = new.groupBy("id").agg(F.max_by(F.struct("vector", "metadata"), "_order").alias("r")).select("id", "r.vector", "r.metadata")
        if self.metric == "cosine":
            new = new.withColumn("vector", normalise(F.col("vector")))
        new = new.select("id", "vector", "metadata")
        cells = self._cells()
        if self.nlist and cells is None and new.where(F.col("vector").isNotNull()).limit(self.nlist).count() >= self.nlist:
            train_cells(new.where(F.col("vector").isNotNull()).select(F.col("vector").alias("v")), self.nlist).coalesce(1).write.parquet(f"{self.path}/cells")
            cells = self._cells()
        placed = assign_cells(new, cells, "vector") if cells is not None else new.withColumn("cell", F.lit(None).cast("int"))
        self._write(placed, mode == "upsert", False)

    def add_documents(self, docs: DataFrame, vectors: DataFrame) -> None:
        """`docs(id, content, metadata)` and `vectors(id, vector)`; the content becomes a metadata entry."""
        meta = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("content"), F.col("content")))
        self.add(docs.join(vectors, "id").select("id", "vector", meta.alias("metadata")))

    def delete(self, ids: DataFrame) -> None:
        """Of `ids(id)`; those that are not there count for nothing."""
        none = [F.lit(None).cast(t).alias(n) for n, t in (("vector", "array<double>"), ("metadata", "map<string,string>"), ("cell", "int"))]
        self._write(ids.select(F.col("id").cast("string").alias("id")).distinct().select("id", *none), True, True)

    def count(self) -> int:
        return self.rows().count()

    def search(self, queries: DataFrame, k: int = 10, filters: dict[str, str] | None = None, post_filter: bool = False, score_kind: str = "raw") -> DataFrame:
        """Top k of `queries(query_id, q)`. Filters hold before the ranking, or with post_filter after it."""
        trained = self._cells()
        rows = self.rows() if trained is None else self.rows(self.probed(queries))
        use = rows if post_filter or not filters else where_metadata(rows, filters)
        vectors, cells = use.select(F.col("id").alias("doc_id"), F.col("vector").alias("v"), "cell"), trained
        if cells is None:
            hits = dense.search(vectors.drop("cell"), queries, k, self.metric, score_kind=score_kind)
        else:  # rows from before the cells were trained are in none: they are searched whole
            near = probe(vectors.where(F.col("cell").isNotNull()), queries, cells, k, self.nprobe, self.metric)
            if self.metric == "l2" and score_kind != "raw":
                near = near.withColumn("score", F.round(1.0 / (1.0 + F.col("score")), 6))
            rest = dense.search(vectors.where(F.col("cell").isNull()).drop("cell"), queries, k, self.metric, score_kind=score_kind)
            hits = topk(near.drop("rank").unionByName(rest.drop("rank")), k, ascending=self.metric == "l2" and score_kind == "raw")
        out = hits.join(rows.select(F.col("id").alias("doc_id"), "metadata"), "doc_id")
        return where_metadata(out, filters) if post_filter and filters else out

    def probed(self, queries: DataFrame) -> list[int] | None:
        """The cells that a search of these queries looks at, of which there are `nlist` at most; None before training."""
        cells = self._cells()
        if cells is None:
            return None
        near = dense.search(cells.select(F.col("cell").alias("doc_id"), F.col("c").alias("v")), queries, self.nprobe, self.metric)
        return sorted(r["doc_id"] for r in near.select("doc_id").distinct().collect())

    def save(self, path: str) -> None:
        """A copy of the rows at another path, which `load` reads."""
        self.rows().write.mode("overwrite").parquet(path)

    def load(self, path: str) -> None:
        """The rows of a copy in the place of what is here."""
        parts = self._segments()
        rows = self.spark.read.schema(SCHEMA).parquet(path)
        self._save(rows, parts[-1][0] + 1 if parts else 0, True, False, False)
        for part in parts:
            self._files.delete(self._path(self._name(*part)), True)


def distance_expression(metric: str, a: Column, b: Column) -> Column:
    """The distance that a metric orders by: cosine 1 - cos, dot minus the product, l2."""
    from siftspan.functions.vector import cosine, dot, l2_distance

    return {"cosine": lambda: 1.0 - cosine(a, b), "dot": lambda: -dot(a, b), "l2": lambda: l2_distance(a, b)}[metric]()
