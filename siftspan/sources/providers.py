"""Language and embedding models as providers: what answers prompts or encodes texts, called once a distinct text.

A provider of answers is a replay table, a rule (an expression over the prompt), or a function that is called with lists
of requests in the tasks, several at a time. A provider of vectors is the hashed embedder, a table of known vectors, or
a function. Texts are made distinct by their sha-256 before the call and joined back, so a repeated prompt or passage
costs one call, whatever the number of rows that hold it. Calls are made from a table of the shared folder, and their
answers are one, so a lost executor repeats its own calls alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspan.functions.text import cache_key
from siftspan.functions.vector import DIM, hashed_vectors, normalise
from siftspan.sources.tables import cut

RESPONSE = "content string, model string, prompt_tokens long, completion_tokens long, total_tokens long"
MESSAGES = "array<struct<role:string,content:string>>"


def messages(prompt: Column, system: Column | None = None) -> Column:
    """The messages of a request: the system's, if it is neither null nor empty, and the user's."""
    def said(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = F.array(said("user", prompt)).cast(MESSAGES)
    return user if system is None else F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.array(said("system", system)).cast(MESSAGES), user)).otherwise(user)


def response(content: Column, model: Column | None = None, **usage: Column) -> Column:
    """struct(content, model, prompt_tokens, completion_tokens, total_tokens) without nulls: empty texts and zeros."""
    text = lambda c: F.coalesce(F.lit(None).cast("string") if c is None else c.cast("string"), F.lit(""))
    counts = [F.coalesce(usage[name].cast("long") if name in usage else F.lit(0).cast("long"), F.lit(0).cast("long")).alias(name) for name in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return F.struct(text(content).alias("content"), text(model).alias("model"), *counts)


@dataclass(frozen=True)
class Options:
    """Of a completion; a request's own temperature or number of tokens takes the place of these."""

    model: str = ""
    temperature: float = 0.0
    max_tokens: int = 1024
    top_p: float = 1.0


@dataclass(frozen=True)
class Completer:
    """Answers `rows(prompt)`: the column `response` by one of three ways.

    replay: a table (prompt_key, content) with sha-256 keys of prompts; a prompt that it lacks has an empty answer.
    rule: an expression of the prompt. call: a function of a request (system, prompt and the options as a dict) that
    returns a text or a dict with content and usage; up to `concurrency` calls a task run at a time, each tried again
    `retries` times; one that fails for good has an empty answer, and `error` says why.
    """

    replay: DataFrame | None = None
    rule: Callable[[Column], Column] | None = None
    call: Callable[[dict], str | dict] | None = None
    options: Options = field(default_factory=Options)
    concurrency: int = 8
    retries: int = 3
    wait: float = 0.5

    def complete(self, rows: DataFrame, prompt: str = "prompt", system: str | None = None, out: str = "response", **options) -> DataFrame:
        """`rows` with the column `out`, a struct as in `response`; a null prompt has an empty answer."""
        own = self.options.__dict__ | options
        if self.rule is not None:
            return rows.withColumn(out, response(self.rule(F.col(prompt)), F.lit(own["model"])))
        if self.replay is not None:
            known = self.replay.groupBy("prompt_key").agg(F.min("content").alias("_said"))
            keyed = rows.withColumn("_key", cache_key(F.col(prompt)))
            return keyed.join(known, keyed["_key"] == known["prompt_key"], "left").drop("prompt_key", "_key").withColumn(out, response(F.col("_said"), F.lit(own["model"]))).drop("_said")
        if self.call is None:
            raise ValueError("a completer needs a replay table, a rule or a call")
        said = F.coalesce(F.col(system), F.lit("")) if system else F.lit("")
        key = cache_key(F.concat_ws("\0", said, F.col(prompt)))
        spark = rows.sparkSession
        asked = cut(spark, rows.where(F.col(prompt).isNotNull()).select(key.alias("_key"), said.alias("system"), F.col(prompt).alias("prompt")).dropDuplicates(["_key"]), "prompts")
        answered = cut(spark, asked.mapInArrow(self._ask(own), f"_key string, {RESPONSE}, error string"), "answers")
        made = answered.select(F.col("_key").alias("_k"), response(F.col("content"), F.col("model"), **{n: F.col(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")}).alias("_r"), F.col("error").alias("_error"))
        joined = rows.withColumn("_key", key).join(made, F.col("_key") == F.col("_k"), "left").drop("_key", "_k")
        empty = response(F.lit(None).cast("string"), F.lit(own["model"]))
        return joined.withColumn(out, F.coalesce("_r", empty)).withColumn(f"{out}_error", F.col("_error")).drop("_r", "_error")

    def _ask(self, options: dict):
        call, retries, wait, workers = self.call, self.retries, self.wait, self.concurrency

        def one(request: dict) -> dict:
            for attempt in range(retries + 1):
                try:
                    got = call(request)
                    got = {"content": got} if isinstance(got, str) or got is None else dict(got)
                    return {"content": "", "model": options["model"], "prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0, "error": None} | {k: v for k, v in got.items() if v is not None}
                except Exception as e:  # a provider can fail in any way; the last failure is told
                    if attempt == retries:
                        return {"content": "", "model": options["model"], "prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0, "error": f"{type(e).__name__}: {e}"[:300]}
                    time.sleep(wait * 2**attempt)
            raise AssertionError

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ("content", "model", "prompt_tokens", "completion_tokens", "total_tokens", "error")
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            with ThreadPoolExecutor(max(1, workers)) as pool:
                for batch in batches:
                    requests = [options | {"system": s, "prompt": p} for s, p in zip(batch.column("system").to_pylist(), batch.column("prompt").to_pylist(), strict=True)]
                    got = list(pool.map(one, requests))
                    yield pa.record_batch([batch.column("_key"), *(pa.array([g[n] for g in got], k) for n, k in zip(names, kinds, strict=True))], names=["_key", *names])

        return run


@dataclass(frozen=True)
class Embedder:
    """Vectors of texts. `known`: a table (text_key, v) by sha-256; `call`: texts to vectors; else the hashed embedder.

    `cache`: a shared folder that keeps what `call` gave, by sha-256 of the text: texts that it has are not asked for
    again, by this or a later run. A cache is of one model: the folder's name should say which.
    """

    dimension: int = DIM
    call: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None
    known: DataFrame | None = None
    batch: int = 32
    unit: bool = True
    cache: str | None = None

    def encode(self, rows: DataFrame, key: list[str], text: str) -> DataFrame:
        """(key..., v array<double>) of every row with a vector: texts without words have none from the hashed embedder,
        and texts that `known` lacks have none."""
        if self.known is not None:
            v = self.known.select("text_key", F.col("v").cast("array<double>").alias("v")).dropDuplicates(["text_key"])
            joined = rows.select(*key, cache_key(F.col(text)).alias("text_key")).join(v, "text_key")
            return joined.select(*key, (normalise(F.col("v")) if self.unit else F.col("v")).alias("v"))
        if self.call is None:
            return hashed_vectors(rows, key, text, self.dimension)
        spark, call, size, dim, unit = rows.sparkSession, self.call, self.batch, self.dimension, self.unit

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                v = np.concatenate([np.asarray(call(texts[at : at + size]), np.float64).reshape(-1, dim) for at in range(0, len(texts), size)]) if texts else np.zeros((0, dim))
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10) if unit else v
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("text_key"), lists], names=["text_key", "v"])

        keyed = rows.select(*key, F.col(text).alias("text"), cache_key(F.col(text)).alias("text_key")).where(F.col("text").isNotNull())
        distinct = cut(spark, keyed.select("text_key", "text").dropDuplicates(["text_key"]), "texts")
        if self.cache is None:
            made = cut(spark, distinct.mapInArrow(run, "text_key string, v array<double>"), "vectors")
        else:
            made = self._cached(distinct, run)
        return keyed.select(*key, "text_key").join(made, "text_key").select(*key, "v")

    def _cached(self, distinct: DataFrame, run) -> DataFrame:
        """(text_key, v) of the texts: those that the cache lacks are asked for and added to it, in a file a task.

        Two runs at the same time may both ask for a text; its first vector by value counts then, for both.
        """
        spark, schema = distinct.sparkSession, "text_key string, v array<double>"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.cache)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        lacked = distinct.join(spark.read.schema(schema).parquet(self.cache).select("text_key"), "text_key", "left_anti") if there else distinct
        lacked.select("text_key", "text").mapInArrow(run, schema).write.mode("append").parquet(self.cache)
        # Only the keys that are asked for travel; vectors of others are left where they are.
        return spark.read.schema(schema).parquet(self.cache).join(distinct.select("text_key"), "text_key", "left_semi").groupBy("text_key").agg(F.min("v").alias("v"))
