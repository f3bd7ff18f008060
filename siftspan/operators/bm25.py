"""BM25 for all queries at once: document frequencies in one pass, then scores in blocks where documents are read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.functions.text import tokens
from siftspan.operators import blocks
from siftspan.operators.topk import by_max, topk
from siftspan.sources.tables import cut


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf) of `docs(doc_id, text)`; the length travels with the terms, so nothing is joined for it."""
    rows = docs.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return rows.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): repeated terms of a query count as often as they occur."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: the number of documents, and their mean length (1 without any token)."""
    dl = F.size(tokens(F.coalesce("text", F.lit(""))))
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.when(F.avg(dl) > 0, F.avg(dl)), F.lit(1.0)).alias("avgdl"))


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_id, t array<string>) of `docs(doc_id, text)`; a null text has no terms."""
    return docs.select("doc_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))


@dataclass(frozen=True)
class Index:
    """What queries need of a corpus: its terms by document, documents by term, their number and mean length."""

    words: DataFrame
    frequencies: DataFrame
    n: int
    mean: float


def index(spark: SparkSession, docs: DataFrame) -> Index:
    """Terms and frequencies of `docs(doc_id, text)` as tables of the shared folder, for any number of query batches."""
    words = cut(spark, tokenised(docs), "terms")
    df = cut(spark, words.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    n, mean = words.agg(F.count("*"), F.avg(F.size("t"))).first()
    return Index(words, df, n, mean or 1.0)


def weigher(k1: float, b: float, mean: float) -> blocks.Weigh:
    return lambda tf, dl: tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / mean))


def scores(docs: DataFrame | Index, queries: DataFrame, k: int, grid: list[tuple[float, float]], normalised: bool = True) -> DataFrame:
    """(trial, query_id, doc_id, score): raw BM25 sums for each (k1, b) of a grid, with the k best of each query and trial.

    Rows beyond the k best are there as well, those that rounding could tie with them among others. Up to MAX_BLOCKS
    blocks of queries are passes over the documents; more take the inverted-index join. Without an index, the documents
    are cut into terms twice: for the frequencies of the queries' terms, and for the scores.
    """
    known = isinstance(docs, Index)
    words = docs.words if known else tokenised(docs)
    weights = query_terms(queries)
    found = blocks.blocks(weights)
    if found is None:
        return _joined(words, weights, grid)
    terms = sorted({t for f in found for t in f.terms})
    if known:
        n, mean = docs.n, docs.mean
        asked = queries.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        df = {r["term"]: r["df"] for r in docs.frequencies.join(F.broadcast(asked), "term", "left_semi").collect()}
    else:
        n, total, df, _ = blocks.statistics(words, terms)
        mean = total / n if total else 1.0
    parts = []
    for f in found:
        idf = np.array([np.log((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5) + 1.0) for t in f.rows["term"]])
        weight = f.rows["qtf"].to_numpy(float) * idf
        # No score is above the sum of idf (k1 + 1): the sixth digit of a share of the best is that much.
        most = np.bincount(f.rows["q"], weight, minlength=len(f.ids))
        slack = np.array([2e-6 * ((k1 + 1.0) * most if normalised else np.ones_like(most)) for k1, _ in grid])
        parts.append(blocks.search(words, f, weight, [weigher(k1, b, mean) for k1, b in grid], k, slack))
    return blocks.union(parts) if parts else blocks.nothing(words, queries)


def _joined(words: DataFrame, weights: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    stats = words.agg(F.count("*").alias("n"), F.coalesce(F.when(F.avg(F.size("t")) > 0, F.avg(F.size("t"))), F.lit(1.0)).alias("mean"))
    seen = words.select(F.explode(F.array_distinct("t")).alias("term")).join(weights.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    ready = weights.join(seen.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "mean"), "term")

    def part(k1: float, b: float):
        return F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("mean")))

    return blocks.union([blocks.joined(words, ready, lambda r, k1=k1, b=b: r.withColumn("part", part(k1, b))).select(F.lit(trial).alias("trial"), "query_id", "doc_id", "score") for trial, (k1, b) in enumerate(grid)])


def retrieve(docs: DataFrame | Index, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, threshold: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score, rank): scores over the best of their query, positive ones alone."""
    found = by_max(scores(docs, queries, k, [(k1, b)]).drop("trial"))
    return topk(found, k, threshold=threshold).select("query_id", "doc_id", "score", "rank")
