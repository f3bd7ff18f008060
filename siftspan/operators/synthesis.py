"""Synthetic question-answer samples from documents, with hash picks instead of a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.functions.text import json_part, prompt

TYPES = ("factual", "reasoning", "comparison", "multi_hop")
LEVELS = ("easy", "medium", "hard")
TEMPLATE = "Write one {difficulty} {question_type} question that this passage answers, as JSON with question and answer.\n\n{context}"


def _pick(key: Column, options: tuple[str, ...]) -> Column:
    at = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % len(options)
    return F.element_at(F.array(*[F.lit(o) for o in options]), at.cast("int") + 1)


def requests(spark: SparkSession, docs: DataFrame, per_doc: int = 3, types: tuple[str, ...] = TYPES, levels: tuple[str, ...] = LEVELS, max_context: int = 2000, seed: int = 42) -> DataFrame:
    """(doc_id, n, question_type, difficulty, context, prompt): `per_doc` requests a document."""
    rows = docs.select("doc_id", F.substring("text", 1, max_context).alias("context"), F.explode(F.sequence(F.lit(0), F.lit(per_doc - 1))).alias("n"))
    key = F.concat_ws("-", F.lit(seed), F.col("doc_id"), F.col("n"))
    rows = rows.withColumn("question_type", _pick(F.concat(key, F.lit("-t")), types)).withColumn("difficulty", _pick(F.concat(key, F.lit("-d")), levels))
    return rows.withColumn("prompt", prompt(TEMPLATE, difficulty=F.col("difficulty"), question_type=F.col("question_type"), context=F.col("context")))


def samples(answered: DataFrame, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Samples from requests with a `content` that holds JSON with question and answer; others are dropped.

    With a limit, rows in the order of md5(seed, doc_id, n).
    """
    parsed = F.from_json(json_part(F.col("content")), "question string, answer string")
    rows = answered.withColumn("qa", parsed).where(F.col("qa.question").isNotNull() & F.col("qa.answer").isNotNull())
    out = rows.select("doc_id", "n", "question_type", "difficulty", F.col("qa.question").alias("query"), F.col("qa.answer").alias("answer"), F.array("context").alias("contexts"), F.col("qa.answer").alias("ground_truth"))
    return out.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col("doc_id"), F.col("n")))).limit(limit) if limit else out


def adversarial(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(doc_id, prompt) for n documents in the order of md5(seed, doc_id): questions that the passage can't answer."""
    some = docs.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col("doc_id"))), "doc_id").limit(n)
    return some.select("doc_id", prompt("Write a question that looks answerable from this passage but is not, as JSON with question and answer.\n\n{context}", context=F.substring("text", 1, 2000)).alias("prompt"))
