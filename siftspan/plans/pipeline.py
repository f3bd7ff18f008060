"""A retrieval pipeline over DataFrames: chunk, retrieve for all queries at once, evaluate."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.operators import chunkers, dense, fusion, metrics
from siftspan.operators.postings import Postings
from siftspan.sources.providers import Embedder
from siftspan.sources.tables import cut, shared_dir


@dataclass(frozen=True)
class Config:
    chunker: str = "recursive"
    chunk_size: int = 512
    chunk_overlap: int = 64
    strategy: str = "bm25"
    top_k: int = 5
    k1: float = 1.5
    b: float = 0.75
    dense_weight: float = 0.5

    def __post_init__(self):
        if not 64 <= self.chunk_size <= 4096 or not 0 <= self.chunk_overlap <= 512 or not 1 <= self.top_k <= 100:
            raise ValueError("chunk_size must be in 64..4096, chunk_overlap in 0..512, top_k in 1..100")


class Pipeline:
    """Chunks, their terms and their vectors are tables of the shared folder, made once and read by every query batch."""

    def __init__(self, spark: SparkSession, config: Config = Config(), embedder: Embedder = Embedder()):
        self.spark, self.config, self.embedder = spark, config, embedder
        self.chunks: DataFrame | None = None
        self.documents = 0
        self._index: Postings | None = None
        self._vectors: DataFrame | None = None

    def ingest(self, docs: DataFrame) -> int:
        """Adds `docs(doc_id, text)`; returns the number of chunks of them. What is there already is not read again: the
        index gets a segment, the vectors a table."""
        c = self.config
        new = cut(self.spark, chunkers.chunk(docs, c.chunker, c.chunk_size, c.chunk_overlap).select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")), "chunks")
        self.chunks = new if self.chunks is None else self.chunks.unionByName(new)
        if c.strategy != "bm25":
            vectors = cut(self.spark, self.embedder.encode(new, ["doc_id"], "text"), "chunk-vectors")
            self._vectors = vectors if self._vectors is None else self._vectors.unionByName(vectors)
        if c.strategy in ("bm25", "hybrid"):
            self._index = self._index or Postings(self.spark, f"{shared_dir(self.spark)}/postings-{uuid.uuid4().hex}")
            self._index.add(new)
        self.documents += docs.count()
        return new.count()

    @property
    def num_chunks(self) -> int:
        return 0 if self.chunks is None else self.chunks.count()

    def query(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) for `queries(query_id long, query)`."""
        c, k = self.config, top_k or self.config.top_k
        lexical = lambda n: self._index.retrieve(queries, n, c.k1, c.b)
        vectors = lambda n: dense.search(self._vectors, self.embedder.encode(queries, ["query_id"], "query").withColumnRenamed("v", "q"), n)
        if c.strategy == "bm25":
            return lexical(k)
        if c.strategy == "hybrid":
            return fusion.rrf([(vectors(3 * k), "dense", c.dense_weight), (lexical(3 * k), "bm25", 1 - c.dense_weight)], k).select("query_id", "doc_id", "score", "rank")
        return vectors(k)

    def samples(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """Samples of `queries(query_id, query, ground_truth?)`: the answer is the starts of the first three hits."""
        hits = self.query(queries, top_k).join(self.chunks, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("h"))
        texts = F.transform(F.coalesce("h", F.array().cast("array<struct<rank:int,text:string>>")), lambda x: x["text"])
        truth = F.col("ground_truth") if "ground_truth" in queries.columns else F.lit(None).cast("string")
        answer = F.array_join(F.transform(F.slice(texts, 1, 3), lambda t: F.substring(t, 1, 200)), " ")
        return queries.join(hits, "query_id", "left").select(F.col("query_id").alias("sample_id"), "query", answer.alias("answer"), texts.alias("contexts"), truth.alias("ground_truth"), F.lit(0.0).alias("latency_seconds"))

    def evaluate(self, queries: DataFrame, names: tuple[str, ...] = metrics.NAMES) -> DataFrame:
        return metrics.evaluate(self.samples(queries), names)
