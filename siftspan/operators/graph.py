"""Retrieval over a graph of triples: entity links, breadth-first search, depth scores, and a word-overlap fallback."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspan.functions.text import entity, let, trigram_jaccard, trigrams, ws_tokens
from siftspan.functions.text import triples as parsed
from siftspan.operators import blocks
from siftspan.operators.topk import by_max, topk
from siftspan.sources.providers import Completer
from siftspan.sources.tables import cut


def edges(triples: DataFrame) -> DataFrame:
    """(entity, predicate, neighbour, doc_id), both ways, of (subject, predicate, object, doc_id); empty entities go."""
    t = triples.select(entity(F.col("subject")).alias("s"), "predicate", entity(F.col("object")).alias("o"), "doc_id").where((F.col("s") != "") & (F.col("o") != ""))
    return t.select(F.col("s").alias("entity"), "predicate", F.col("o").alias("neighbour"), "doc_id").unionByName(t.select(F.col("o").alias("entity"), "predicate", F.col("s").alias("neighbour"), "doc_id"))


def entity_docs(triples: DataFrame) -> DataFrame:
    return edges(triples).select("entity", "doc_id").distinct()


#: Fixed value: the request for triples. The parser of answers relies on the bars.
TRIPLES = "List what the passage states, a line for each: subject | predicate | object. Nothing else.\n<passage>"


def extracted(docs: DataFrame, completer: Completer) -> DataFrame:
    """(subject, predicate, object, doc_id) of `docs(doc_id, text)`: what a provider says that each passage states.

    One request a distinct text; lines without three parts are left out, and repeated ones of a document count once.
    """
    asked = docs.where(F.col("text").isNotNull()).select("doc_id", F.concat(F.lit(TRIPLES), F.col("text"), F.lit("</passage>")).alias("prompt"))
    said = completer.complete(asked).select("doc_id", F.explode(parsed(F.col("response.content"))).alias("t"))
    return said.select("t.subject", "t.predicate", "t.object", "doc_id").distinct()


def gram_sets(strings: DataFrame, name: str) -> DataFrame:
    """`strings` with `grams`: the distinct trigrams of a string; of one that is too short, itself with a sign before."""
    c = F.col(name)
    return strings.withColumn("grams", F.when(F.length(c) >= 3, trigrams(c)).otherwise(F.array(F.concat(F.lit("="), c))))


def candidates(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(x, y) of `a(x, grams)` and `b(y, grams)`, distinct strings: pairs whose sets may have that Jaccard similarity.

    Grams are put in order of rarity, over both sides. Two sets that are similar enough share one of the first
    n - ceil(threshold n) + 1 of each; their sizes are within a factor of the threshold; and what can follow a shared
    gram has to make up for the rest. So common grams, which nearly all strings have, are seldom looked up. No pair
    that is similar enough is left out; without a threshold, all that share a gram are candidates.
    """
    both = a.select("grams").unionByName(b.select("grams"))
    often = both.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))

    def prefixes(side: DataFrame, name: str) -> DataFrame:
        # Names compress so well that their rows can seem small enough for the driver; a gram has one count.
        rows = side.select(F.col(name), F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(often.hint("shuffle_hash"), "gram")
        place = F.row_number().over(W.partitionBy(name).orderBy("often", "gram"))
        # A little is taken off before rounding up, as products of decimals are not exact.
        keep = F.col("n") - F.greatest(F.ceil(F.col("n") * threshold - 1e-9), F.lit(1)) + 1
        return rows.withColumn("i", place).where(F.col("i") <= keep).select("gram", name, F.col("n").alias(f"n_{name}"), F.col("i").alias(f"i_{name}"))

    # A gram's pairs are more than the rows that a shuffle of prefixes shows: they are dealt out to all partitions, and
    # no side, which is small when compressed alone, is sent to the driver.
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = prefixes(a, "x").repartition(parts, "gram").join(prefixes(b, "y").repartition(parts, "gram").hint("merge"), "gram")
    sizes = (F.col("n_x") >= F.col("n_y") * threshold - 1e-9) & (F.col("n_y") >= F.col("n_x") * threshold - 1e-9)
    # At the first gram that both have, all that they share is it and what follows; at later ones less follows, so a pair
    # passes at any of its grams only if it does at the first.
    rest = 1 + F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y"))
    return met.where(sizes & (rest * (1 + threshold) >= threshold * (F.col("n_x") + F.col("n_y")) - 1e-9)).select("x", "y").distinct()


def gram_key(c: Column) -> Column:
    """A string's distinct trigrams in one string, the same for equal sets; of one that is too short, itself."""
    return F.when(F.length(c) >= 3, F.array_join(F.sort_array(trigrams(c)), "")).otherwise(c)


def one_apart(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y) of `a(x, grams)` and `b(y, grams)`, distinct sets: equal ones, and those where one has a gram more.

    A set's mark is the XOR of its grams' hashes. The mark of one side is looked up among those of the other side, whole
    or without one of the grams. A mark has one whole set, so rows are no more than the grams; hashes that are equal by
    chance add pairs, which the similarity sorts out.
    """

    def marks(side: DataFrame, name: str, whole_as: tuple[int, int], less_as: int) -> DataFrame:
        mark = lambda kind, m: F.struct(F.lit(kind).alias("kind"), m.alias("mark"))
        made = lambda h: let(F.aggregate(h, F.lit(0).cast("bigint"), lambda s, g: s.bitwiseXOR(g)), lambda m: F.concat(F.array(*[mark(k, m) for k in whole_as]), F.transform(h, lambda g: mark(less_as, m.bitwiseXOR(g)))))
        # No set is empty; the plain explode would make the marks once more for its filter.
        rows = side.select(name, F.explode_outer(let(F.transform("grams", lambda g: F.xxhash64(g)), made)).alias("m"))
        return rows.select(name, "m.kind", "m.mark")

    return marks(a, "x", (0, 1), 2).join(marks(b, "y", (0, 2), 1).hint("merge"), ["kind", "mark"]).select("x", "y")


def nearest(pairs: DataFrame, threshold: float) -> DataFrame:
    """(x, y, similarity): the most similar `y` of each `x` in `pairs(x, y)`; equal similarities: the smaller one."""
    best = F.min(let(trigram_jaccard(F.col("x"), F.col("y")), lambda j: F.when(j >= threshold, F.struct((-F.round(j, 6)).alias("s"), F.col("y").alias("y"), j.alias("similarity")))))
    return pairs.groupBy("x").agg(best.alias("b")).where(F.col("b").isNotNull()).select("x", "b.y", "b.similarity")


def link(mentions: DataFrame, entities: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(query_id, mention, entity, similarity): for each (query_id, mention) the most similar entity, if near enough.

    Strings without trigrams match only themselves. Equal similarities: the smaller name. Strings with equal sets of
    grams are compared once, by the smallest. Those that have an entity `one_apart` are done with it where none further
    away can be as similar; only the others meet their `candidates`, whose pairs can grow with the square of the names.
    """
    spark = mentions.sparkSession
    m = mentions.select("query_id", entity(F.col("mention")).alias("mention")).where(F.col("mention") != "").distinct()
    e = entities.select("entity").where(F.col("entity") != "").distinct()
    names = cut(spark, m.select("mention").distinct().withColumn("key", gram_key(F.col("mention"))), "mentions")
    xs = names.groupBy("key").agg(F.min("mention").alias("x"))
    ys = cut(spark, e.withColumn("key", gram_key(F.col("entity"))).groupBy("key").agg(F.min("entity").alias("y")).select("y"), "entities")
    first = nearest(one_apart(gram_sets(xs.select("x"), "x"), gram_sets(ys, "y")), threshold)
    # Of two more or fewer grams, the most similar are all of x and two more.
    n = F.greatest(F.length("key") / 3, F.lit(1.0))
    beyond = n / (n + 2)
    done = (beyond < threshold - 1e-9) | (F.coalesce(F.round("similarity", 6), F.lit(-1.0)) > F.round(beyond, 6))
    found = cut(spark, xs.join(first.hint("merge"), "x", "left").withColumn("done", done), "near")
    best = found.where(F.col("done") & F.col("y").isNotNull()).select("key", "y", "similarity")
    rest = found.where(~F.col("done")).select("key", "x")
    if not rest.isEmpty():
        further = nearest(candidates(gram_sets(rest.select("x"), "x"), gram_sets(ys, "y"), threshold), threshold)
        best = best.unionByName(rest.join(further.hint("merge"), "x").select("key", "y", "similarity"))
    linked = names.join(best.hint("merge"), "key").select("mention", F.col("y").alias("entity"), "similarity")
    return m.join(linked.hint("merge"), "mention").select("query_id", "mention", "entity", "similarity")


def bfs(spark: SparkSession, seeds: DataFrame, graph: DataFrame, max_hops: int = 2) -> DataFrame:
    """(query_id, entity, depth) within `max_hops` of the seeds (query_id, entity): a join a hop, what is seen left out."""
    steps = graph.select("entity", "neighbour").distinct()
    seen = seeds.select("query_id", "entity").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for hop in range(1, max_hops + 1):
        new = frontier.join(steps, "entity").select("query_id", F.col("neighbour").alias("entity")).distinct().join(seen, ["query_id", "entity"], "left_anti").withColumn("depth", F.lit(hop))
        frontier = cut(spark, new, "bfs")
        seen = seen.unionByName(frontier)
    return seen


def scored_docs(reached: DataFrame, docs_of: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """Top k of 1 / (1 + least depth of an entity of the document), over the best of the query.

    Documents of one depth rank by id, so of an entity's documents only the k with the least ids can be among the k
    best of a query; and where an entity has k, what is deeper than it can't be. Both go before they are paired.
    """
    place = F.dense_rank().over(W.partitionBy("entity").orderBy("doc_id"))
    lists = docs_of.withColumn("_place", place).where(F.col("_place") <= k).groupBy("entity").agg(F.collect_set(F.struct("doc_id")).alias("_docs"))
    full = lists.where(F.size("_docs") >= k).select("entity")
    limit = reached.join(full, "entity").groupBy("query_id").agg(F.min("depth").alias("_limit"))
    near = reached.join(limit, "query_id", "left").where(F.col("_limit").isNull() | (F.col("depth") <= F.col("_limit")))
    met = near.join(lists, "entity").select("query_id", "depth", F.explode("_docs").alias("_doc")).select("query_id", "depth", F.col("_doc.doc_id").alias("doc_id"))
    depth = met.groupBy("query_id", "doc_id").agg(F.min("depth").alias("depth"))
    return topk(by_max(depth.withColumn("score", 1.0 / (1.0 + F.col("depth")))), k, threshold=threshold).select("query_id", "doc_id", "score", "rank", "depth")


def overlap(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """Top k by the share of the query's words that the document has; without a threshold."""
    q = queries.select("query_id", F.array_distinct(ws_tokens(F.col("query"))).alias("w")).select("query_id", F.size("w").alias("n"), F.explode("w").alias("term"))
    d = docs.select("doc_id", F.array_distinct(ws_tokens(F.coalesce("text", F.lit("")))).alias("t"))
    found = blocks.blocks(q)
    if found is None:
        rows = blocks.joined(d, q, lambda r: r.withColumn("part", 1.0 / F.col("n")))
    elif found:
        rows = blocks.union([blocks.search(d, f, 1.0 / f.rows["n"].to_numpy(float), [lambda tf, dl: np.ones(len(tf))], k, np.full((1, len(f.ids)), 2e-6)) for f in found])
    else:
        rows = blocks.nothing(d, q)
    return topk(rows, k).select("query_id", "doc_id", "score", "rank")


def retrieve(spark: SparkSession, queries: DataFrame, mentions: DataFrame, triples: DataFrame, docs: DataFrame, k: int = 10, max_hops: int = 2, similarity: float = 0.8, threshold: float = 0.0) -> DataFrame:
    """Graph retrieval for all queries; those of which no mention is linked fall back to word overlap."""
    graph, docs_of = edges(triples), entity_docs(triples)
    linked = cut(spark, link(mentions, docs_of.select("entity"), similarity), "links")
    found = scored_docs(bfs(spark, linked.select("query_id", "entity"), graph, max_hops), docs_of, k, threshold)
    rest = queries.join(linked.select("query_id").distinct(), "query_id", "left_anti")
    return found.drop("depth").unionByName(overlap(rest, docs, k))
