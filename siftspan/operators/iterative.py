"""Strategies that retrieve in rounds. Decisions come from providers: expressions over columns, or joined replay tables.

Each round is one plan over all queries that are still active; rounds are bounded, and what they found is a table of
the shared folder before the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.functions.text import note_blocks, thought_query
from siftspan.operators.topk import topk
from siftspan.sources.providers import Completer
from siftspan.sources.tables import cut, is_whole

Search = Callable[[DataFrame, int], DataFrame]


def multi_hop(spark: SparkSession, queries: DataFrame, docs: DataFrame, search: Search, next_query: Column, enough: Column, k: int = 10, max_hops: int = 3, per_hop: int = 3) -> DataFrame:
    """Up to `max_hops` searches; a document counts by its first hop with score x (1 - 0.1 hop).

    `next_query` and `enough` are expressions over query, evidence (array of texts, the last five found) and found
    (their number); `enough` needs two results or more to stop a query.
    """
    return _rounds(spark, queries, docs, search, next_query, enough & (F.col("found") >= 2), k, max_hops, per_hop, 0.1, stop_first=True)


def interleaved(spark: SparkSession, queries: DataFrame, docs: DataFrame, search: Search, next_query: Column, done: Column, k: int = 10, max_steps: int = 4, per_step: int = 3) -> DataFrame:
    """Up to `max_steps` thoughts, each followed by a search; score x (1 - 0.05 step); the search of a final thought
    still runs. `next_query` and `done` are expressions over query, evidence and found."""
    return _rounds(spark, queries, docs, search, next_query, done, k, max_steps, per_step, 0.05, stop_first=False)


def _rounds(spark, queries, docs, search, next_query, stop, k, rounds, per_round, decay, stop_first):
    state = queries.select("query_id", "query", F.col("query").alias("ask"))
    found = None
    for step in range(rounds):
        if not stop_first:
            state = cut(spark, _with_evidence(state, found, docs).select("query_id", "query", next_query.alias("ask"), stop.alias("last")), "thought")
        hits = search(state.select("query_id", F.col("ask").alias("query")), per_round).select("query_id", "doc_id", (F.col("score") * (1.0 - decay * step)).alias("score"), F.lit(step).alias("step"))
        if found is not None:
            hits = hits.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        hits = cut(spark, hits, "round")
        found = hits if found is None else found.unionByName(hits)
        if stop_first:
            state = _with_evidence(state, found, docs).where(~stop).select("query_id", "query", next_query.alias("ask"))
        else:
            state = state.where(~F.col("last")).select("query_id", "query", "ask")
        state = cut(spark, state, "state")
        if step + 1 < rounds and state.isEmpty():
            break
    return topk(found, k).select("query_id", "doc_id", "score", "rank", "step")


#: Fixed value: what a thinker is asked for. The parser of answers relies on QUERY:.
THINK = "\nSay in a sentence what is still missing, then on a line of its own QUERY: and the next search, or QUERY: alone if nothing is."


def thinking(spark: SparkSession, queries: DataFrame, docs: DataFrame, search: Search, completer: Completer, path: str, k: int = 10, max_steps: int = 4, per_step: int = 3) -> DataFrame:
    """(query_id, doc_id, score, rank, step): rounds of a thought, by a provider, and a search for what it asks.

    A request holds the query and the first 200 characters of the last five texts found. An answer without a QUERY:
    line searches for the query itself; an empty one ends the query. Scores are those of the first step that found a
    document x (1 - 0.05 step). Requests, answers and hits of each step are tables under `path` in a shared folder: a
    run that was lost, or that had fewer steps, goes on after its last whole table, without asking anything again.
    """
    found = None
    active = queries.select("query_id", "query")
    for step in range(max_steps):
        asked_at, hits_at = f"{path}/{step}/asked", f"{path}/{step}/hits"
        if not is_whole(spark, asked_at):
            seen = F.array_join(F.transform("evidence", lambda t: F.concat(F.lit("\n* "), F.substring(t, 1, 200))), "")
            prompt = F.concat(F.lit("Question: "), F.col("query"), F.format_string("\nStep %d, %d texts so far:", F.lit(step + 1), F.col("found")), seen, F.lit(THINK))
            said = completer.complete(_with_evidence(active, found, docs).select("query_id", "query", prompt.alias("prompt")))
            thought = thought_query(F.col("response.content"), F.col("query"))
            said.select("query_id", "query", "prompt", thought["thought"].alias("thought"), thought["query"].alias("ask")).write.mode("overwrite").parquet(asked_at)
        asked = spark.read.parquet(asked_at).where(F.col("ask") != "")
        if not is_whole(spark, hits_at):
            hits = search(asked.select("query_id", F.col("ask").alias("query")), per_step).select("query_id", "doc_id", (F.col("score") * (1.0 - 0.05 * step)).alias("score"), F.lit(step).alias("step"))
            if found is not None:
                hits = hits.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
            hits.write.mode("overwrite").parquet(hits_at)
        hits = spark.read.parquet(hits_at)
        found = hits if found is None else found.unionByName(hits)
        active = asked.select("query_id", "query")
        if active.isEmpty():
            break
    return topk(found, k).select("query_id", "doc_id", "score", "rank", "step")


def _with_evidence(state: DataFrame, found: DataFrame | None, docs: DataFrame) -> DataFrame:
    if found is None:
        return state.withColumn("evidence", F.array().cast("array<string>")).withColumn("found", F.lit(0))
    rows = found.join(docs.select("doc_id", "text"), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("step", (-F.col("score")).alias("s"), "doc_id", "text"))).alias("r"))
    seen = rows.select("query_id", F.size("r").alias("found"), F.transform(F.slice(F.col("r"), F.greatest(F.size("r") - 4, F.lit(1)), 5), lambda x: x["text"]).alias("evidence"))
    return state.join(seen, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0))).withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def self_reflective(spark: SparkSession, queries: DataFrame, docs: DataFrame, search: Search, judge: Column, refine: Column, again: Column, k: int = 10, max_iterations: int = 3) -> DataFrame:
    """Retrieve, judge, refine: up to `max_iterations` searches of 2k documents with the refined query.

    `judge` is an expression over query and text that gives struct(is_relevant, is_supported, is_useful, confidence);
    unseen documents that are relevant and supported stay with score x confidence. `again` decides before every later
    round whether to search, `refine` makes the next query; both see query, evidence and found.
    """
    state = queries.select("query_id", "query", F.col("query").alias("ask"))
    kept = seen = None
    for step in range(max_iterations):
        if step:
            state = cut(spark, _with_evidence(state, kept, docs).where(again).select("query_id", "query", refine.alias("ask")), "state")
            if state.isEmpty():
                break
        hits = search(state.select("query_id", F.col("ask").alias("query")), 2 * k).select("query_id", "doc_id", "score")
        if seen is not None:
            hits = hits.join(seen, ["query_id", "doc_id"], "left_anti")
        judged = hits.join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", "text"), "doc_id").withColumn("j", judge)
        judged = cut(spark, judged.select("query_id", "doc_id", (F.col("score") * F.col("j.confidence")).alias("score"), (F.col("j.is_relevant") & F.col("j.is_supported")).alias("good"), F.lit(step).alias("step")), "judged")
        good, new = judged.where("good").drop("good"), judged.select("query_id", "doc_id")
        kept, seen = (good, new) if kept is None else (kept.unionByName(good), seen.unionByName(new))
    return topk(kept, k).select("query_id", "doc_id", "score", "rank", "step")


#: What a note's relevance multiplies a score by, and what its type adds.
FACTORS = {"relevant": 1.2, "partially_relevant": 0.8, "irrelevant": 0.2}
BONUS = {"complementary": 0.1, "standard": 0.0, "conflicting": -0.05}


def note_score(score: Column, relevance: Column, note_type: Column) -> Column:
    """The score times the factor of the relevance (0.5 for others) plus the bonus of the type, within 0 and 1."""
    factor, bonus = F.lit(0.5), F.lit(0.0)
    for k, v in FACTORS.items():
        factor = F.when(relevance == k, v).otherwise(factor)
    for k, v in BONUS.items():
        bonus = F.when(note_type == k, v).otherwise(bonus)
    return F.least(F.greatest(score * factor + bonus, F.lit(0.0)), F.lit(1.0))


def noted(hits: DataFrame, queries: DataFrame, docs: DataFrame, note: Column, k: int = 10) -> DataFrame:
    """Scores moved by reading notes: `note` is an expression over query and text, struct(relevance, note_type, ...)."""
    rows = hits.select("query_id", "doc_id", "score").join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", "text"), "doc_id").withColumn("note", note)
    moved = note_score(F.col("score"), F.col("note.relevance"), F.col("note.note_type"))
    return topk(rows.withColumn("score", moved), k).select("query_id", "doc_id", "score", "rank", F.col("note.relevance").alias("relevance"), F.col("note.note_type").alias("note_type"))


#: The request for notes. Readers of answers rely on its field names.
NOTES = (
    "Write a reading note on each document, in their order, separated by blank lines.\n"
    "Each note has four lines: RELEVANCE: relevant, partially_relevant or irrelevant; KEY_INFO: what matters most in the document; "
    "CONNECTION: how it bears on the query; TYPE: standard, conflicting or complementary.\n\n"
)


def chain_of_notes(spark: SparkSession, hits: DataFrame, queries: DataFrame, docs: DataFrame, completer: Completer, k: int = 10, batch: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank, relevance, key_info, connection, note_type, original_score).

    The candidates of a query are read `batch` at a time in order of rank; a request holds the first 500 characters of
    each and the last three notes before it. Notes come back by position: a document without one has a partially
    relevant standard note. One round of requests for all queries, as many rounds as the most candidates need.
    """
    rows = hits.select("query_id", "doc_id", "score", "rank").join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", F.substring("text", 1, 500).alias("text")), "doc_id")
    rows = cut(spark, rows.withColumn("round", F.floor((F.col("rank") - 1) / batch).cast("int")).withColumn("place", ((F.col("rank") - 1) % batch).cast("int")), "candidates")
    rounds = rows.agg(F.max("round").alias("n")).first()["n"]
    notes = None
    for n in range(0 if rounds is None else rounds + 1):
        listed = F.array_sort(F.collect_list(F.struct("place", "doc_id", "text")))
        text = F.array_join(F.transform(listed, lambda d: F.concat(F.lit("<text no="), (d["place"] + 1).cast("string"), F.lit(" key="), d["doc_id"].cast("string"), F.lit(">"), d["text"])), "\n\n")
        asked = rows.where(F.col("round") == n).groupBy("query_id", "query").agg(text.alias("documents"))
        if notes is None:
            asked = asked.withColumn("before", F.lit(""))
        else:
            last = notes.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "relevance", "key_info"))).alias("l"))
            told = F.array_join(F.transform(F.slice("l", F.greatest(F.size("l") - 2, F.lit(1)), 3), lambda x: F.concat_ws(" / ", x["doc_id"].cast("string"), x["relevance"], F.substring(x["key_info"], 1, 100))), "; ")
            asked = asked.join(last.select("query_id", F.concat(F.lit("\nNoted so far: "), told).alias("before")), "query_id", "left").withColumn("before", F.coalesce("before", F.lit("")))
        prompt = F.concat(F.lit(NOTES + "Query: "), F.col("query"), F.lit("\n"), F.col("before"), F.lit("\nTexts:\n"), F.col("documents"))
        said = completer.complete(asked.select("query_id", prompt.alias("prompt")))
        found = said.select("query_id", F.posexplode(note_blocks(F.col("response.content"))).alias("place", "note"))
        here = rows.where(F.col("round") == n).join(found, ["query_id", "place"], "left")
        note = lambda name, default: F.coalesce(F.col("note")[name], F.lit(default)).alias(name)
        here = cut(spark, here.select("query_id", "doc_id", "score", "rank", note("relevance", "partially_relevant"), note("key_info", ""), note("connection", ""), note("note_type", "standard")), "notes")
        notes = here if notes is None else notes.unionByName(here)
    if notes is None:
        notes = rows.select("query_id", "doc_id", "score", "rank", *[F.lit("").alias(c) for c in ("relevance", "key_info", "connection", "note_type")])
    moved = notes.drop("rank").withColumn("original_score", F.col("score")).withColumn("score", note_score(F.col("score"), F.col("relevance"), F.col("note_type")))
    return topk(moved, k)
