"""Sparse weights, rank fusion, late interaction and reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspan.functions.text import tokens
from siftspan.functions.vector import sigmoid
from siftspan.operators import blocks, bm25
from siftspan.operators.topk import by_max, topk


def log_tf_weights(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, weight): log1p of term counts, the offline stand-in for a learned sparse encoder."""
    return rows.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.log1p(F.count("*").cast("double")).alias("weight"))


def saturate(logits: DataFrame, key: str) -> DataFrame:
    """(key, token, weight) from token logits (key, token, logit): the largest log1p of the positive part."""
    return logits.groupBy(key, "token").agg(F.max(F.log1p(F.greatest(F.col("logit"), F.lit(0.0)))).alias("weight")).where(F.col("weight") > 0)


def sparse_search(docs: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """Top k by the dot product of (doc_id, token, weight) and (query_id, token, weight), over the best of the query."""
    q = queries.select("query_id", "token", F.col("weight").alias("qw"))
    raw = docs.join(q, "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score")).where(F.col("score") > 0)
    return topk(by_max(raw), k, threshold=threshold).select("query_id", "doc_id", "score", "rank")


def log_tf_search(docs: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """`sparse_search` of the `log_tf_weights` of `docs(doc_id, text)` and `queries(query_id, query)`, in blocks of queries."""
    words = bm25.tokenised(docs)
    weights = bm25.query_terms(queries)
    found = blocks.blocks(weights)
    if found is None:
        return sparse_search(log_tf_weights(docs, "doc_id", "text"), log_tf_weights(queries, "query_id", "query"), k, threshold)
    most = np.log1p(blocks.statistics(words, [])[3])  # of a term's weight
    parts = []
    for f in found:
        weight = np.log1p(f.rows["qtf"].to_numpy(float))
        slack = 2e-6 * most * np.bincount(f.rows["q"], weight, minlength=len(f.ids))[None]
        parts.append(blocks.search(words, f, weight, [lambda tf, dl: np.log1p(tf)], k, slack))
    raw = blocks.union(parts) if parts else blocks.nothing(docs, queries)
    return topk(by_max(raw), k, threshold=threshold).select("query_id", "doc_id", "score", "rank")


def rrf(hits: list[tuple[DataFrame, str, float]], k: int = 10, rrf_k: int = 60, threshold: float = 0.0) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, score, rank) with their names and weights.

    A row has the fused score over the best of its query, the raw sum, and the strategy and score of the best original
    row (the larger score; the first list of equal ones). No list: no rows, which the caller has to give a schema.
    """
    parts = None
    for order, (rows, name, weight) in enumerate(hits):
        one = rows.select("query_id", "doc_id", "score", (F.lit(float(weight)) / (rrf_k + F.col("rank"))).alias("part"), F.lit(name).alias("strategy"), F.lit(-order).alias("order"))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        raise ValueError("no lists to fuse")
    fused = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("raw_score"), F.max_by("strategy", F.struct("score", "order")).alias("original_strategy"), F.max("score").alias("original_score"))
    return topk(by_max(fused.withColumn("score", F.col("raw_score"))), k, threshold=threshold)


#: Query token vectors that a task holds, and dot products that it has at once.
TOKENS, PRODUCTS = 16384, 4 << 20


def max_sim(doc_tokens: DataFrame, query_tokens: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """Late interaction: (doc_id, i, v) against a stated set (query_id, qi, q) of query token vectors.

    For each query token the best dot product among the tokens of a document, summed over query tokens; divided by the
    best of the query if that is positive. The vectors of a document are brought together, meet blocks of whole queries
    in matrix products, and only what can be among the k best of a query leaves a task. Each block of about TOKENS
    query vectors is a pass over the documents.
    """
    kinds = doc_tokens.schema["doc_id"].dataType.simpleString()
    docs = doc_tokens.groupBy("doc_id").agg(F.flatten(F.collect_list(F.col("v").cast("array<double>"))).alias("v"), F.count("*").alias("n"))
    parts = max(1, -(-query_tokens.count() // TOKENS))
    found = []
    for part in range(parts):
        here = query_tokens if parts == 1 else query_tokens.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        rows = here.select("query_id", "qi", F.col("q").cast("array<double>").alias("q")).orderBy("query_id", "qi").collect()
        if rows:
            found.append(docs.mapInArrow(_max_sims(rows, k), f"query_id long, doc_id {kinds}, score double"))
    if not found:
        return topk(by_max(blocks.nothing(doc_tokens, query_tokens)), k).select("query_id", "doc_id", "score", "rank")
    return topk(by_max(blocks.union(found)), k, threshold=threshold).select("query_id", "doc_id", "score", "rank")


def _max_sims(rows: list, k: int):
    q = np.array([r["q"] for r in rows])
    ids = np.array([r["query_id"] for r in rows], np.int64)
    first = np.flatnonzero(np.append([True], ids[1:] != ids[:-1]))
    size = np.add.reduceat(np.linalg.norm(q, axis=1), first)  # no score is above this by the longest vector of a document

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            flat = np.asarray(batch.column("v").flatten(), np.float64)
            if len(flat) != n.sum() * q.shape[1]:
                raise ValueError("vectors of documents and queries differ in length")
            v, ends = flat.reshape(-1, q.shape[1]), np.cumsum(n)
            scores = np.empty((len(n), len(first)))
            step = max(1, PRODUCTS // len(q))
            at = 0
            while at < len(n):  # as many documents as `step` vectors make, one at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + step, "right")))
                begin = ends[at:to] - n[at:to]
                best = np.maximum.reduceat(v[begin[0] : ends[to - 1]] @ q.T, begin - begin[0], axis=0)
                scores[at:to] = np.add.reduceat(best, first, axis=1)
                at = to
            keep = min(k, len(scores))
            if not keep:
                continue
            # Scores are compared by the sixth digit of their share of the best.
            edge = np.partition(scores, len(scores) - keep, axis=0)[len(scores) - keep] - 2e-6 * size * max(1.0, float(np.linalg.norm(v, axis=1).max()))
            i, j = np.nonzero(scores >= edge[None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[first][j]), batch.column("doc_id").take(pa.array(i)), pa.array(scores[i, j])], names=["query_id", "doc_id", "score"])

    return run


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, logit: Column, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """Candidates (query_id, doc_id) scored anew: sigmoid of `logit`, an expression over the columns query and text."""
    pairs = hits.select("query_id", "doc_id", F.col("score").alias("first_score")).join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    return topk(pairs.withColumn("score", sigmoid(logit)), k, threshold=threshold).select("query_id", "doc_id", "score", "rank", "first_score")


def mean_vector(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): the mean of the vectors of each key, component by component, not scaled again."""
    parts = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))


def last_n(rows: DataFrame, key: str, order: str, n: int, value: str) -> DataFrame:
    """(key, values): the last n values of each key, in order."""
    kept = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("_n") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda p: p[value]).alias("values"))
