"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, secret redaction, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.llm import line_dedup, packing, secrets, simhash, toxicity
from siftspan.llm.common import ARROW_ROWS, modest_batches, remove, shared_dir, temporary
from siftspan.llm.queries import vocabulary


#: Bits in which first and second fingerprints of candidates differ at most: a Jaccard similarity of 0.8 is about 10 bits
#: (three deviations more are 18), unrelated texts are at 32.
NEAR_BITS, SECOND_BITS = 16, 20
#: The encoder's dictionaries and slices in the last stage: small, as the stages before have left executors little memory.
PACK_CODES, PACK_BYTES = 40_000, 512 << 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, by a lexicon learned from the labels of documents that are here, is under 0.5."""
    modest_batches(spark)
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, lexicon)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; documents of which nothing is left go."""
    modest_batches(spark)
    done = line_dedup.dedup(spark, docs)
    return done.where((F.col("dropped_chars") == 0) | (F.btrim(F.col("text"), F.lit(" \t\r\n\f\v")) != "")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id: 5-word shingles with a Jaccard similarity of 0.8 or more."""
    modest_batches(spark)
    return simhash.keep_one(spark, docs, radius=NEAR_BITS, words=5, jaccard=0.8, second=SECOND_BITS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in the place of each secret."""
    modest_batches(spark)
    return secrets.redact(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    modest_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), size=1024, end_id=0, max_codes=PACK_CODES, slice_bytes=PACK_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack),
]
#: SQL has no Aho-Corasick, patience diff, SimHash or byte-pair encoding: tests compare with brute force stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage returns is a table of the shared folder for the next.

    Tables that a stage made for itself go when its result is written, that result when the next one is. The session's
    Arrow batches, which stages make smaller, are what they were at the end.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    rows = spark.conf.get(ARROW_ROWS)
    try:
        for k, (_, stage) in enumerate(STAGES):
            with temporary(spark):
                stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
            if k:
                remove(spark, f"{where}/{k - 1}")
            docs = spark.read.parquet(f"{where}/{k}")
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    return docs
