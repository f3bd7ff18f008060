"""Runs the headline queries on BENCH_SF_DIR with local[BENCH_CPUS] and prints one JSON line.

Each query is run once to warm up code and caches and once for the figure; all its rows are made (a write to the noop
sink). `batch` has queries a second of the registered searches, which cut documents into terms or vectors anew.
`indexed` separates the two, as published figures do: seconds to build an index, then searches of all benchmark items
as one batch (mean milliseconds a query), and batches of a single query (percentiles of their latency), which a Spark
job's fixed cost dominates.
"""

from __future__ import annotations

import json
import os
import resource
import sys
import time
import uuid

HEADLINE = ["bm25_topk", "dense_topk", "text_embed_topk", "hybrid_rrf", "splade_topk", "colbert_maxsim", "hyde", "rerank", "self_rag", "chunk_fixed", "chunk_recursive", "metric_tokens", "ab_welch", "ab_permutation", "pareto_frontier", "optimizer_trials", "latency_percentiles", "pareto_orders"]
SEARCHES = ("bm25_topk", "text_embed_topk", "hybrid_rrf", "splade_topk", "colbert_maxsim", "hyde", "rerank", "self_rag")
SINGLE = 12  # batches of one query


def timed(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def indexed(spark, sf: str) -> dict:
    """Index seconds and search figures of BM25, dense search, their fusion and late interaction."""
    from pyspark.sql import functions as F

    from siftspan.functions.vector import hashed_vectors
    from siftspan.operators import bm25, dense, fusion
    from siftspan.operators.postings import Postings
    from siftspan.plans.retrieval_queries import docs_of, items_of, window_vectors
    from siftspan.sources.tables import cut, shared_dir

    docs, items = docs_of(spark, sf), items_of(spark, sf)
    embedded = lambda q: hashed_vectors(q, ["query_id"], "query").withColumnRenamed("v", "q")
    took = {}

    def build(name, make):
        began = time.perf_counter()
        out = make()
        took[name] = round(time.perf_counter() - began, 3)
        return out

    lexical = build("bm25", lambda: bm25.index(spark, docs))
    inverted = Postings(spark, f"{shared_dir(spark)}/bench-postings-{uuid.uuid4().hex}")
    build("bm25_postings", lambda: inverted.add(docs))
    vectors = build("dense", lambda: cut(spark, hashed_vectors(docs, ["doc_id"], "text"), "bench-vectors"))
    windows = build("colbert", lambda: cut(spark, window_vectors(docs, "doc_id", "text", 180), "bench-windows"))
    took["hybrid"] = round(took["bm25"] + took["dense"], 3)
    tokens = lambda q: window_vectors(q, "query_id", "query", 32).select("query_id", F.col("i").alias("qi"), F.col("v").alias("q"))
    search = {
        "bm25": lambda q: bm25.retrieve(lexical, q, 10),
        "bm25_postings": lambda q: inverted.retrieve(q, 10),
        "dense": lambda q: dense.search(vectors, embedded(q), 10),
        "hybrid": lambda q: fusion.rrf([(dense.search(vectors, embedded(q), 30), "dense", 0.5), (bm25.retrieve(lexical, q, 30), "bm25", 0.5)], 10),
        "colbert": lambda q: fusion.max_sim(windows, tokens(q), 10),
    }
    n, n_docs = items.count(), docs.count()
    one = cut(spark, items.orderBy("query_id").limit(SINGLE), "bench-items")
    ids = sorted(r["query_id"] for r in one.collect())
    out = {}
    for name, f in search.items():
        began = time.perf_counter()
        f(items).write.format("noop").mode("overwrite").save()
        cold = time.perf_counter() - began
        began = time.perf_counter()
        f(items).write.format("noop").mode("overwrite").save()
        warm = time.perf_counter() - began
        single = []
        for i in ids:
            began = time.perf_counter()
            f(one.where(F.col("query_id") == i)).write.format("noop").mode("overwrite").save()
            single.append(1000 * (time.perf_counter() - began))
        single.sort()
        at = lambda p: round(single[min(len(single) - 1, int(p * len(single)))], 1)
        out[name] = {
            "index_s": took[name], "batch_cold_s": round(cold, 3), "batch_s": round(warm, 3), "queries": n, "documents": n_docs, "ms_per_query": round(1000 * warm / n, 2), "queries_per_s": round(n / warm, 1),
            "ms_per_query_per_1000_documents": round(1e6 * warm / n / n_docs, 3), "single_ms": {"p50": at(0.5), "p95": at(0.95), "p99": at(0.99)},
        }
    return out


def main() -> None:
    from siftspan.plans import registry
    from siftspan.sources.session import session
    from siftspan.sources.tables import table

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    memory = os.environ.get("BENCH_MEMORY", "16g")
    spark = session("bench", f"local[{cpus}]", int(cpus), spark__driver__memory=memory, spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir="file:///tmp/siftspan-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    items = table(spark, sf, "benchmark").count()
    cold, warm = {}, {}
    for name in names:
        for where in (cold, warm):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            where[name] = round(time.perf_counter() - began, 3)
    searches = [n for n in SEARCHES if n in warm]
    print(json.dumps({
        "metric": "warm seconds of the headline queries", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": sf, "cpus": int(cpus), "memory": memory, "spark": spark.version,
        "batch": {n: {"queries": items, "queries_per_s": round(items / warm[n], 1), "ms_per_query": round(1000 * warm[n] / items, 2)} for n in searches},
        "indexed": {} if sys.argv[1:] else indexed(spark, sf), "driver_python_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024,
    }))


if __name__ == "__main__":
    main()
