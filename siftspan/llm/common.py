"""What the operators share: text slices of Arrow batches, cut points, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that an operator holds in numpy arrays at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) from batches of an id and a text column, at most `limit` bytes together; a null text is empty."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at, size = 0, 0
        lengths = [n or 0 for n in pc.binary_length(texts).to_pylist()]
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield ids.slice(at, i - at).to_pylist(), [t or "" for t in texts.slice(at, i - at).to_pylist()]
                at, size = i, 0
            size += n
        if at < len(lengths):
            yield ids.slice(at).to_pylist(), [t or "" for t in texts.slice(at).to_pylist()]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, whose worker gives freed memory back to the system at its end: workers live on, and an
    executor has several of them at rest beside those that work."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


#: Rows of an Arrow batch, where the session does not ask for fewer: texts are long, and Spark's 10,000 rows of them
#: are held several times over by the executor and its Python workers.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def modest_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows at most: what is computed later runs under this setting, so the
    registered queries leave it; `corpus_pipeline.run`, which writes all that it computes, sets it back."""
    now = int(spark.conf.get(ARROW_ROWS))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir; where it is unset, one under the warehouse if all
    runs on this machine (a master that begins with local), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cuts"
    return root.rstrip("/")


_MADE: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Cuts that are made inside are deleted at the end: what is built on them has to be written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            remove(spark, path)


def cut(spark: SparkSession, df: DataFrame, label: str, by: str | None = None, compression: str | None = None) -> tuple[DataFrame, str]:
    """`df` written to the shared folder and read back, with its path: ends the lineage and survives lost executors.

    Rows of each value of `by`, a column of few values, have files of their own.
    """
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _MADE[-1:]:
        made.append(path)
    schema = df.schema
    out = df.write.option("compression", compression) if compression else df.write
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(schema).parquet(path), path


#: Spark's own switch: shuffle files go at the end of the action that made them, not when the driver's memory is collected.
SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Actions inside run with a setting of the session that is put back after them."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def short_shuffles(spark: SparkSession):
    """Actions inside leave no shuffle files behind: each has to write what others need of it."""
    return setting(spark, SHORT_SHUFFLES, "true")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a cut that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Edges that one task takes whole, in a union-find of about 100 bytes an edge; more of them take the distributed way,
#: to the same result. Rounds of jobs over a few thousand rows would cost more than everything before them.
TASK_EDGES = 1 << 20


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(spark: SparkSession, edges: DataFrame, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges(a long, b long)`: rows (node long, component long), the smallest node of each.

    Up to TASK_EDGES distinct edges, counted first, are the work of one task. More of them take alternating large-star
    and small-star steps on edges that point from the larger to the smaller node. Each step is a grouped minimum
    (combined before the shuffle, so a hub costs one row a task) and a join with those minima; both sides of the join
    are tables of the shared folder, so that AQE can split the rows of a hub. Nothing is collected but a count a
    round. Loops and repeated edges are ignored; an edge with a null end is dropped. `edges` is read twice, so it should
    be a table or a cut.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(big.alias("a"), small.alias("b")).distinct()
    if e.count() <= TASK_EDGES:
        return e.coalesce(1).mapInArrow(tidy(_forest), "node long, component long")
    e, path = cut(spark, e, label)
    for _ in range(max_rounds):
        # A node with two out-edges, or a target that has an out-edge itself, means that stars have not formed yet.
        least, least_path = cut(spark, e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), label)
        up = least.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        # large-star: a -> the least neighbour of b
        large = e.join(up, "b", "left").select("a", F.coalesce("mb", "b").alias("b"), F.col("mb").isNotNull().alias("moved"))
        large, large_path = cut(spark, large, label)
        moved = large.agg(F.max(F.col("moved").cast("int")).alias("x")).first()["x"] or 0
        many = least.agg(F.max("n").alias("x")).first()["x"] or 0
        if not moved and many <= 1:
            remove(spark, large_path)
            remove(spark, path)
            roots = least.select(F.col("m").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return least.select(F.col("a").alias("node"), F.col("m").alias("component")).unionByName(roots)
        # small-star: the out-neighbours of a -> the least of them, and a as well
        low, low_path = cut(spark, large.groupBy("a").agg(F.min("b").alias("m")), label)
        joined = large.select("a", "b").join(low, "a")
        new = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e2, path2 = cut(spark, new, label)
        for old in (path, least_path, large_path, low_path):
            remove(spark, old)
        e, path = e2, path2
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")
