"""Answer metrics over samples (query, answer, contexts, ground_truth, latency_seconds), as columns of one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspan.functions.text import contains_yes, dot_sentences, let, token_f1, ws_tokens
from siftspan.functions.vector import cosine, embed_all

NAMES = ("faithfulness", "answer_relevance", "context_relevance", "coherence", "context_recall", "context_precision", "answer_correctness", "latency_score")


def joined(contexts: Column) -> Column:
    return F.lower(F.array_join(F.coalesce(contexts, F.array().cast("array<string>")), " "))


def faithfulness(answer: Column, contexts: Column) -> Column:
    """Share of the answer's words, repeats included, that the contexts have."""
    share = lambda a, c: F.when((F.size(a) == 0) | (F.size(c) == 0), 0.0).otherwise(F.size(F.filter(a, lambda t: F.array_contains(c, t))) / F.size(a))
    return let(ws_tokens(answer), lambda a: let(F.array_intersect(a, ws_tokens(joined(contexts))), lambda c: share(a, c)))


def answer_relevance(query: Column, answer: Column, q: Column, a: Column) -> Column:
    """Cosine of the vectors q and a, not under 0; an empty text 0."""
    return F.when((query == "") | (answer == ""), 0.0).otherwise(F.greatest(F.lit(0.0), cosine(q, a)))


def share_near(target: Column, t: Column, contexts: Column) -> Column:
    """Share of context vectors with a cosine of 0.5 or more (to nine digits) to the vector t of a target text."""
    return F.when((target == "") | (F.coalesce(F.size(contexts), F.lit(0)) <= 0), 0.0).otherwise(F.size(F.filter(contexts, lambda c: F.round(cosine(t, c), 9) >= 0.5)) / F.size(contexts))


def coherence(answer: Column, vectors: Column) -> Column:
    """Mean cosine, not under 0, of the vectors of consecutive sentences; one sentence or a blank answer 1, an empty one 0."""
    n = F.size(vectors)
    pairs = F.zip_with(F.slice(vectors, 1, F.greatest(n - 1, F.lit(0))), F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.greatest(F.lit(0.0), cosine(a, b)))
    return F.when(F.coalesce(answer, F.lit("")) == "", 0.0).when(n <= 1, 1.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (n - 1))


def context_recall(contexts: Column, truth: Column) -> Column:
    """Share of the distinct words of the ground truth that the contexts have."""
    t, c = F.array_distinct(ws_tokens(F.coalesce(truth, F.lit("")))), F.array_distinct(ws_tokens(joined(contexts)))
    return F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.array_intersect(t, c)) / F.size(t))


def answer_correctness(answer: Column, truth: Column, a: Column, t: Column) -> Column:
    """Half token F1, half cosine of the vectors a and t."""
    known = F.coalesce(truth, F.lit(""))
    return F.when((known == "") | (answer == ""), 0.0).otherwise(0.5 * token_f1(answer, known) + 0.5 * F.greatest(F.lit(0.0), cosine(a, t)))


def latency_score(seconds: Column, cap: float = 10.0) -> Column:
    return F.when(seconds.isNull(), 0.0).when(seconds <= 0, 1.0).otherwise(1.0 - F.least(seconds / cap, F.lit(1.0)))


def columns(cap: float = 10.0) -> dict[str, Column]:
    """The metrics over a sample's columns and its vectors _q, _a, _t, _c (contexts) and _s (sentences of the answer)."""
    q, a, c, t, s = (F.col(x) for x in ("query", "answer", "contexts", "ground_truth", "latency_seconds"))
    known = F.nullif(t, F.lit(""))
    return {
        "faithfulness": faithfulness(a, c),
        "answer_relevance": answer_relevance(q, a, F.col("_q"), F.col("_a")),
        "context_relevance": share_near(q, F.col("_q"), F.col("_c")),
        "coherence": coherence(a, F.col("_s")),
        "context_recall": context_recall(c, t),
        "context_precision": share_near(F.coalesce(known, q), F.when(known.isNull(), F.col("_q")).otherwise(F.col("_t")), F.col("_c")),
        "answer_correctness": answer_correctness(a, t, F.col("_a"), F.col("_t")),
        "latency_score": latency_score(s, cap),
    }


def with_vectors(samples: DataFrame, embedder: Callable[[Column], Column] = embed_all) -> DataFrame:
    """Samples with the vectors of all their texts, from one call of the embedder (array of texts to array of vectors)."""
    contexts, spoken = F.coalesce("contexts", F.array().cast("array<string>")), dot_sentences(F.coalesce("answer", F.lit("")))
    texts = F.concat(F.array(*[F.coalesce(c, F.lit("")) for c in ("query", "answer", "ground_truth")]), contexts, spoken)
    rows = samples.withColumn("_v", embedder(texts)).withColumn("_n", F.size(contexts))
    at = lambda k: F.element_at("_v", k)
    return rows.select("*", at(1).alias("_q"), at(2).alias("_a"), at(3).alias("_t"), F.slice("_v", F.lit(4), F.col("_n")).alias("_c"), F.slice("_v", F.col("_n") + 4, F.size("_v")).alias("_s")).drop("_v", "_n")


def evaluate(samples: DataFrame, names: tuple[str, ...] = NAMES, key: str = "sample_id", embedder: Callable[[Column], Column] = embed_all, cap: float = 10.0) -> DataFrame:
    """(key, metric, score), long; names that are not metrics are skipped."""
    made = columns(cap)
    use = [n for n in names if n in made]
    wide = with_vectors(samples, embedder).select(key, *[F.round(made[n], 6).alias(n) for n in use])
    return wide.unpivot([key], use, "metric", "score")


def means(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(by or []), "metric").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))


def harmonic(scores: DataFrame) -> DataFrame:
    """One row: the harmonic mean of the positive means of the metrics, 0 without any."""
    m = means(scores)
    pos = F.col("mean_score") > 0
    return m.agg(F.coalesce(F.count_if(pos) / F.sum(F.when(pos, 1.0 / F.col("mean_score"))), F.lit(0.0)).alias("overall"))


def judged_faithfulness(claims: DataFrame, verdict: Column, key: str = "sample_id") -> DataFrame:
    """(key, score): the share of claims with a verdict that says yes; samples whose claims are an empty array get 1."""
    rows = claims.select(key, F.explode_outer("claims").alias("claim"))
    return rows.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("claim").isNotNull(), contains_yes(verdict).cast("double"))), F.lit(1.0)).alias("score"))
