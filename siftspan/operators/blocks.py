"""Sparse search in blocks: documents' terms, where they are read, against a matrix of query terms.

An inverted-index join pairs every query with every document for each common term, and the shuffle carries them all.
Here a task holds the weights of a block of queries (terms x queries), scores the documents of an Arrow batch by small
products, and keeps only what can be among the k best of a query: nothing but those rows is shuffled. Query sets of
more than MAX_BLOCKS blocks take the join (`joined`), which has the same results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries of a block, blocks that are passes over the documents, and numbers of a block's matrix that are used at once.
BLOCK, MAX_BLOCKS, CELLS = 4096, 16, 4 << 20

#: Weights of a document's terms from their counts and the document's length.
Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Queries:
    """A block: ids, terms, and the weights as (number of the term, number of the query, weight), by query."""

    ids: pa.Array
    terms: dict[str, int]
    rows: pd.DataFrame


def blocks(weights: DataFrame) -> list[Queries] | None:
    """The blocks of `weights(query_id, term, ...)`; None if there are too many."""
    n = weights.select("query_id").distinct().count()
    parts = -(-n // BLOCK)
    if parts > MAX_BLOCKS:
        return None
    out = []
    for k in range(parts):
        part = weights if parts == 1 else weights.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)
        rows = part.toPandas().sort_values(["query_id", "term"], kind="stable").reset_index(drop=True)
        ids, terms = rows["query_id"].unique(), rows["term"].unique()
        names = {t: i for i, t in enumerate(terms)}
        rows["t"], rows["q"] = rows["term"].map(names), rows["query_id"].map({q: i for i, q in enumerate(ids)})
        out.append(Queries(pa.array(ids.tolist()), names, rows))
    return out


def counted(lists: pa.Array, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the known terms of lists of strings, by document, and the lengths of the lists."""
    lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    flat = lists.flatten().dictionary_encode()
    known = np.array([terms.get(t, -1) for t in flat.dictionary.to_pylist()], np.int64)
    of = known[np.asarray(flat.indices, np.int64)] if len(known) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    pair, count = np.unique((doc * max(len(terms), 1) + of)[of >= 0], return_counts=True)
    doc, of = np.divmod(pair, max(len(terms), 1))
    return doc, of, count, lengths


def statistics(docs: DataFrame, terms: list[str]) -> tuple[int, int, dict[str, int], int]:
    """Of `docs(t array<string>)`: their number, the sum of their lengths, documents of each term, and the longest one.

    One pass, whose tasks return a row a term that they have seen.
    """
    names = {t: i for i, t in enumerate(terms)}

    def run(batches):
        df, n, total, most = np.zeros(len(names), np.int64), 0, 0, 0
        for batch in batches:
            _, of, _, lengths = counted(batch.column(0), names)
            df += np.bincount(of, minlength=len(names))
            n, total, most = n + len(lengths), total + int(lengths.sum()), max(most, int(lengths.max(initial=0)))
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append([-3, -2, -1], seen)), pa.array(np.append([most, total, n], df[seen]))], names=["k", "n"])

    rows = docs.select("t").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"), F.max("n").alias("m")).collect()
    got = {r["k"]: (r["n"], r["m"]) for r in rows}
    return got.get(-1, (0, 0))[0], got.get(-2, (0, 0))[0], {terms[k]: n for k, (n, _) in got.items() if k >= 0}, got.get(-3, (0, 0))[1]


def search(docs: DataFrame, block: Queries, weight: np.ndarray, weigh: list[Weigh], k: int, slack: np.ndarray) -> DataFrame:
    """(trial, query_id, doc_id, score) of `docs(doc_id, t array<string>)`: positive sums of products of weights.

    `weight`: of the rows of the block. A trial is a number of `weigh`. Each task returns rows that are among the k best
    of their query that it has seen by then, and those within `slack` (by trial and query) of the last of them.
    """
    n_queries, n_terms = len(block.ids), len(block.terms)
    step = max(1, CELLS // max(n_terms, 1))
    of_term, of_query, ids = block.rows["t"].to_numpy(np.int64), block.rows["q"].to_numpy(np.int64), block.ids
    terms = block.terms

    def run(batches):
        def pieces():
            for at in range(0, n_queries, step):
                here = (of_query >= at) & (of_query < at + step)
                m = np.zeros((n_terms, min(step, n_queries - at)))
                m[of_term[here], of_query[here] - at] = weight[here]
                yield at, m

        # One piece is kept; several are made anew for each batch, so that a task holds one at a time.
        kept = list(pieces()) if n_queries <= step else None
        # The k best scores of each trial and query so far, the least one first.
        best = np.full((len(weigh), k, n_queries), -np.inf)
        for batch in batches:
            doc, of, count, lengths = counted(batch.column(1), terms)
            some, first = np.unique(doc, return_index=True)
            stop = np.append(first[1:], len(doc))
            weights = [f(count, lengths[doc]) for f in weigh]
            for at, m in kept if kept is not None else pieces():
                for trial, w in enumerate(weights):
                    scores = np.stack([w[a:b] @ m[of[a:b]] for a, b in zip(first, stop, strict=True)]) if len(some) else np.zeros((0, m.shape[1]))
                    keep = min(k, len(scores))
                    if not keep:
                        continue
                    here = slice(at, at + m.shape[1])
                    top = np.partition(scores, len(scores) - keep, axis=0)[len(scores) - keep :]
                    best[trial, :, here] = np.partition(np.vstack([best[trial, :, here], top]), keep, axis=0)[keep:]
                    edge = best[trial, 0, here] - slack[trial, here]
                    i, j = np.nonzero((scores >= edge[None]) & (scores > 0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), trial, np.int32)), ids.take(pa.array(j + at)), batch.column(0).take(pa.array(some[i])), pa.array(scores[i, j])], names=["trial", "query_id", "doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    query_kind = "string" if pa.types.is_string(ids.type) else "long"
    return docs.select("doc_id", "t").mapInArrow(run, f"trial int, query_id {query_kind}, doc_id {kind}, score double")


def joined(docs: DataFrame, weights: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, doc_id, score) by the inverted index: `docs(doc_id, t)`, and `weights(query_id, term, ...)` by term.

    `score` makes the part of each row of (doc_id, dl, term, tf, query_id, ...).
    """
    rows = docs.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(weights.select("term").distinct(), "term", "left_semi")
    tf = rows.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    return score(tf.join(weights, "term")).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")).where(F.col("score") > 0)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nothing(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """No hits, of the types of the ids."""
    kinds = [f.schema[x].dataType.simpleString() for f, x in ((queries, "query_id"), (docs, "doc_id"))]
    return docs.sparkSession.createDataFrame([], f"trial int, query_id {kinds[0]}, doc_id {kinds[1]}, score double")
