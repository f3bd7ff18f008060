"""Dense search: all vectors against a set of queries, by blocks of matrix products, with a partial top-k in each task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspan.operators.topk import topk

#: Query vectors that a task holds: 4096 of 64 doubles are 2 MB. More queries are searched in as many passes.
BLOCK = 4096
#: Scores that a task computes at once, so that its memory is the same for any number of queries.
CELLS = 1 << 20


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dim).any():
        raise ValueError(f"queries have {dim} components, a vector has {int(lengths[lengths != dim][0])}")
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", threshold: float = 0.0, score_kind: str = "raw", near: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of `vectors(doc_id, v)` for `queries(query_id, q)`.

    metric: cosine and dot rank by falling similarity; l2 by rising distance (score_kind raw) or by 1 / (1 + distance)
    (score_kind similarity). Vectors of zero length have cosine 0. Null vectors are in no result; vectors with another
    number of components than the queries are an error. With `near(query_id, cell)`, a query meets the vectors of its
    cells alone, of `vectors(doc_id, v, cell)`.
    """
    known = queries.where(F.col("q").isNotNull())
    if near is not None:
        known = known.join(near.groupBy("query_id").agg(F.collect_set("cell").alias("cells")), "query_id")
    n = known.count()
    blocks = max(1, -(-n // BLOCK))
    # A block holds what a hash deals to it, so its size is about BLOCK whatever the ids are.
    parts = [_search(vectors, known if blocks == 1 else known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k, metric, threshold, score_kind) for i in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search(vectors: DataFrame, queries: DataFrame, k: int, metric: str, threshold: float, score_kind: str) -> DataFrame:
    ascending = metric == "l2" and score_kind == "raw"
    in_cells = "cells" in queries.columns
    rows = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), *["cells"] * in_cells).orderBy("query_id").collect()
    ids = [r["query_id"] for r in rows]
    if len({len(r["q"]) for r in rows}) > 1:
        raise ValueError("queries differ in their number of components")
    matrix = np.array([r["q"] for r in rows], np.float64) if rows else np.zeros((0, 1))
    if metric == "cosine" and len(rows):
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-10)

    everyone = np.arange(len(ids))
    askers: dict = {}
    for number, r in enumerate(rows if in_cells else []):
        for cell in r["cells"]:
            askers.setdefault(cell, []).append(number)

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of a batch with the queries that meet them."""
        if not in_cells:
            yield np.arange(batch.num_rows), everyone
            return
        cells = batch.column(2).dictionary_encode()
        of = np.asarray(cells.indices.fill_null(-1), np.int64)
        for k_, cell in enumerate(cells.dictionary.to_pylist()):
            if cell in askers:
                yield np.flatnonzero(of == k_), np.array(askers[cell])

    def score(batches: Iterator[pa.RecordBatch]):
        # The k least losses of each query that this task has seen, the last one the edge of what can be among the best.
        best = np.full((k, len(ids)), np.inf)
        numbers = np.array(ids, np.int64)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            x = _matrix(batch.column(1), matrix.shape[1])
            if metric == "cosine":
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
            for some, asked in groups(batch):
                y, docs = x[some], batch.column(0).take(pa.array(some))
                step, keep = max(1, CELLS // len(y)), min(k, len(y))
                for at in range(0, len(asked), step):
                    here = asked[at : at + step]
                    part = matrix[here]
                    if metric == "l2":
                        s = np.sqrt(np.maximum((y * y).sum(1)[:, None] - 2 * y @ part.T + (part * part).sum(1)[None], 0))
                        s = s if ascending else 1 / (1 + s)
                    else:
                        s = y @ part.T
                    s = np.round(s, 6) + 0.0
                    loss = s if ascending else -s
                    least = np.partition(loss, keep - 1, axis=0)[:keep]
                    best[:, here] = np.partition(np.vstack([best[:, here], least]), k - 1, axis=0)[:k]
                    # Ties at the edge are included.
                    i, j = np.nonzero(loss <= best[k - 1, here][None])
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[here[j]]), docs.take(pa.array(i)), pa.array(s[i, j])], names=["query_id", "doc_id", "score"])

    doc_type = vectors.schema["doc_id"].dataType.simpleString()
    best = vectors.where(F.col("v").isNotNull()).select("doc_id", F.col("v").cast("array<double>").alias("v"), *["cell"] * in_cells).mapInArrow(score, f"query_id long, doc_id {doc_type}, score double")
    return topk(best, k, threshold=threshold, ascending=ascending)
