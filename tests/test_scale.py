"""Operators that do without pairs or whole reads, against brute force: dominance, similar strings, selection, cells."""

import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from siftspan.functions.text import trigram_jaccard
from siftspan.operators import abtest, bm25, graph, iterative, pareto
from siftspan.sources.providers import Completer, Embedder
from siftspan.sources.vector_table import VectorTable


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_dominance_without_pairs(spark, monkeypatch, d):
    """Many ties, repeated points, nulls and a value that most rows share; slabs of a few points."""
    monkeypatch.setattr(pareto, "SLAB", 20)
    draw = random.Random(d)
    data = [[draw.choice([0.0, 0.0, 0.0, 1.0, 2.5, -1.0, None, draw.random()]) for _ in range(d)] for _ in range(300)]
    data += data[:40]
    names = [f"o{i}" for i in range(d)]
    p = spark.createDataFrame([(k, *row) for k, row in enumerate(data)], "point_id long, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {r["point_id"]: r["n_dominating"] for r in pareto.frontier(p, names, ("o0",)).collect()}
    v = np.array([[(x or 0.0) * (-1 if i == 0 else 1) for i, x in enumerate(row)] for row in data])
    want = {k: int(((v >= v[k]).all(axis=1) & (v > v[k]).any(axis=1)).sum()) for k in range(len(v))}
    assert got == want
    assert pareto.frontier(p.where("false"), names).count() == 0


def test_divide_and_conquer():
    draw = np.random.default_rng(3)
    for d in (1, 2, 3):
        data, asked, weight = draw.integers(0, 40, (3000, d)).astype(float), draw.integers(0, 40, (2500, d)).astype(float), draw.integers(1, 5, 3000)
        data[:1200, 0] = 0
        want = (data[None] >= asked[:, None]).all(axis=2) @ weight
        assert (pareto.weigh_above(data, weight, asked) == want).all()


def test_no_nested_loop(spark):
    p = spark.range(50).select(F.col("id").alias("point_id"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    plan = pareto.frontier(p, ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.8, 1.0])
def test_similar_strings(spark, threshold):
    draw = random.Random(5)
    def word():
        return "".join(draw.choice(["customer#", "ab", "c", "d", "é", "00"]) for _ in range(draw.randint(1, 6)))
    names = sorted({word() for _ in range(150)} | {"a", "ab", "abc"})
    asked = [(k, draw.choice(names)[: draw.randint(1, 30)] + draw.choice(["", "c", "ab"])) for k in range(120)] + [(500, ""), (501, "ab"), (502, "A B")]
    entities = spark.createDataFrame([(n,) for n in names + names[:10]], "entity string")
    mentions = spark.createDataFrame(asked + asked[:5], "query_id long, mention string")

    def grams(s):
        return {s[i : i + 3] for i in range(len(s) - 2)} or {"=" + s}

    want = set()
    for q, m in asked:
        m = m.lower().strip()
        best = sorted((-round(len(grams(m) & grams(n)) / len(grams(m) | grams(n)), 6), n) for n in names if m and grams(m) & grams(n) and len(grams(m) & grams(n)) / len(grams(m) | grams(n)) >= threshold)
        if best:
            want.add((q, m, best[0][1], -best[0][0]))
    got = {(r["query_id"], r["mention"], r["entity"], round(r["similarity"], 6)) for r in graph.link(mentions, entities, threshold).collect()}
    assert got == want and len(want) > 20


def test_names_stay_off_the_driver(spark):
    """Mentions and prefixes, which are as many as the names, are shuffled: only the grams' counts may be sent around."""
    names = spark.range(50).select(F.col("id").alias("query_id"), F.concat(F.lit("customer#"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("mention"))
    plan = graph.link(names, names.select(F.col("mention").alias("entity")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and plan.count("BroadcastHashJoin") <= 2


def test_few_candidates(spark):
    """Names that all share their common grams: candidates are those of rare ones, a small part of all pairs."""
    n = 400
    names = spark.range(n).select(F.concat(F.lit("customer#"), F.lpad(F.conv(F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("string"), 10, 36), 9, "0")).alias("entity"))
    sets = graph.gram_sets(names.select(F.col("entity").alias("x")), "x"), graph.gram_sets(names.select(F.col("entity").alias("y")), "y")
    pairs = graph.candidates(*sets, 0.8)
    assert n <= pairs.count() < n * n / 20
    exact = names.select(F.col("entity").alias("x")).crossJoin(names.select(F.col("entity").alias("y"))).where(trigram_jaccard(F.col("x"), F.col("y")) >= 0.8)
    assert exact.join(pairs, ["x", "y"], "left_anti").count() == 0


def test_selection_of_many_scores(spark, monkeypatch):
    """Two metrics of different sizes, equal positions in both arms, and intervals that take several passes."""
    monkeypatch.setattr(abtest, "FEW", 2)
    monkeypatch.setattr(abtest, "HELD", 500)
    draw = random.Random(4)
    rows = [("m", arm, k, draw.random()) for arm, n in (("A", 40), ("B", 70)) for k in range(n)] + [("n", arm, k, draw.choice([0.0, 1.0, None])) for arm in "AB" for k in range(12)] + [("empty", "A", 1, 0.5)]
    data = spark.createDataFrame(rows, "metric string, arm string, pos long, score double").repartition(4)
    want = sorted(map(tuple, abtest.permutation(spark, data, 90).collect()))
    got = sorted(map(tuple, abtest.permutation(spark, data, 90, send_rows=0).collect()))
    assert [r[:1] for r in got] == [r[:1] for r in want] and len(got) == 2
    for a, b in zip(got, want, strict=True):
        assert a[1:] == pytest.approx(b[1:], abs=1e-8)


def test_cells_are_pruned(spark, tmp_path):
    """Files that a search reads fall with the number of probed cells; changes after the base count in all cells."""
    draw = np.random.default_rng(1)
    centers = draw.normal(size=(8, 6)) * 5
    vectors = [(f"v{k}", (centers[k % 8] + draw.normal(size=6) * 0.1).tolist(), {"k": str(k)}) for k in range(160)]
    table = VectorTable(spark, f"{tmp_path}/t", metric="l2", nlist=8, nprobe=1)
    table.add(spark.createDataFrame(vectors, "id string, vector array<double>, metadata map<string,string>"))
    table.compact()
    queries = spark.createDataFrame([(1, centers[3].tolist())], "query_id long, q array<double>")

    def files(n):
        table.nprobe = n
        return len({r["f"] for r in table.rows(table.probed(queries)).select(F.input_file_name().alias("f")).collect()})

    assert len(table.probed(queries)) == 1 and files(1) < files(3) < files(8)
    table.nprobe = 1
    near = {r["doc_id"] for r in table.search(queries, 20).collect()}
    assert near == {f"v{k}" for k in range(160) if k % 8 == 3}
    # One moves to another cell, one is deleted: both are gone from this one, before and after compaction.
    table.add(spark.createDataFrame([("v3", centers[5].tolist(), {})], "id string, vector array<double>, metadata map<string,string>"))
    table.delete(spark.createDataFrame([("v11",)], "id string"))
    for _ in range(2):
        assert {r["doc_id"] for r in table.search(queries, 20).collect()} == near - {"v3", "v11"}
        table.compact()


def test_changes_at_the_same_time(spark, tmp_path):
    """Two writers that saw the same table write segments of their own, and a base doesn't hide what came meanwhile."""
    one, two = VectorTable(spark, f"{tmp_path}/t", metric="dot"), VectorTable(spark, f"{tmp_path}/t")
    row = lambda i: spark.createDataFrame([(i, [1.0, 2.0], {})], "id string, vector array<double>, metadata map<string,string>")
    one.add(row("a"))
    seen = one._segments()
    one._segments = two._segments = lambda: seen
    one.add(row("b"))
    two.add(row("c"))
    del one._segments, two._segments
    assert sorted(r["id"] for r in one.rows().collect()) == ["a", "b", "c"]
    one._segments = lambda: seen  # compacts what it saw first
    one.compact()
    del one._segments
    assert sorted(r["id"] for r in two.rows().collect()) == ["a", "b", "c"]


def test_vectors_are_kept_by_text(spark, tmp_path):
    """What was encoded once is not asked for again; other texts are."""
    asked = spark.sparkContext.accumulator(0)

    def call(texts):
        asked.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    made = Embedder(2, call=call, unit=False, cache=f"{tmp_path}/vectors")
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "k long, text string")
    want = [(1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, [1.0, 1.0])]
    for k in range(2):
        assert sorted(map(tuple, made.encode(rows, ["k"], "text").collect())) == want and asked.value == 2
    more = spark.createDataFrame([(1, "bb"), (9, "ccc")], "k long, text string")
    assert sorted(map(tuple, Embedder(2, call=call, unit=False, cache=made.cache).encode(more, ["k"], "text").collect())) == [(1, [2.0, 1.0]), (9, [3.0, 1.0])]
    assert asked.value == 3


def test_thinking_goes_on(spark, tmp_path):
    """Steps that a lost run has finished are read; only later ones ask."""
    docs = spark.createDataFrame([(1, "red fox den"), (2, "blue fox"), (3, "den of bears"), (4, "bears eat fish"), (5, "fish swim")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "fox"), (2, "swim")], "query_id long, query string")
    asked = spark.sparkContext.accumulator(0)

    def call(request):
        asked.add(1)
        p = request["prompt"]
        if p.startswith("Question: swim"):
            return "nothing is missing\nQUERY:" if "Step 2" in p else "no such line"
        return {"Step 1": "a fox\nQUERY: fox", "Step 2": "its den\nQUERY: den", "Step 3": "who else\nQUERY: bears"}[p.split("\n")[1].split(",")[0]]

    def run(steps):
        return sorted((r["query_id"], r["doc_id"], r["step"]) for r in iterative.thinking(spark, queries, docs, lambda q, k: bm25.retrieve(docs, q, k), Completer(call=call), f"{tmp_path}/run", 10, steps).collect())

    assert run(2) == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 5, 0)] and asked.value == 4
    assert run(2) == run(2) and asked.value == 4
    assert run(3) == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 2), (2, 5, 0)] and asked.value == 5
    step = spark.read.parquet(f"{tmp_path}/run/1/asked").where("query_id = 1").first()
    assert step["thought"] == "its den" and step["ask"] == "den" and "2 texts so far" in step["prompt"] and "red fox den" in step["prompt"]


def test_triples_of_texts(spark):
    docs = spark.createDataFrame([(1, "the fox eats"), (2, "the fox eats"), (3, None), (4, "x")], "doc_id long, text string")
    rule = lambda p: F.when(F.contains(p, F.lit("fox")), "Fox | eats | hen\nbroken line\nFox | eats | hen").otherwise("")
    assert sorted(map(tuple, graph.extracted(docs, Completer(rule=rule)).collect())) == [("Fox", "eats", "hen", 1), ("Fox", "eats", "hen", 2)]


def test_batches_of_registered_queries(spark):
    """A query computes its rows in Arrow batches of modest size, so that a worker's memory doesn't grow with partitions."""
    from siftspan.plans import registry

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows), spark.conf.get(size)
    try:
        spark.conf.set(rows, "10000")
        spark.conf.set(size, str(64 << 20))
        registry.queries()["chunk_recursive"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(rows)) == 1000 and int(spark.conf.get(size).removesuffix("b")) == 16 << 20
    finally:
        spark.conf.set(rows, before[0])
        spark.conf.set(size, before[1])


def test_vectors_of_arrays(spark):
    """Null and empty arrays and null texts, in batches of two rows."""
    from siftspan.functions.vector import embed_all

    texts = spark.createDataFrame([(0, ["one two", None, "one"]), (1, None), (2, []), (3, ["two"]), (4, ["", "one"])], "id long, t array<string>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        got = {r["id"]: r["v"] for r in texts.select("id", embed_all(F.col("t")).alias("v")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [None if got[k] is None else len(got[k]) for k in range(5)] == [3, None, 0, 1, 2]
    assert got[0][1] == got[4][0] == [0.0] * 64 and got[0][2] == got[4][1] and sum(x * x for x in got[3][0]) == pytest.approx(1)


def test_probe_without_pairs(spark):
    """A search in cells against brute force, with ties and null vectors; no row a query and vector is made by a join."""
    from siftspan.sources.vector_table import probe

    draw = np.random.default_rng(5)
    v = np.round(draw.normal(size=(300, 4)), 1)
    cells = draw.integers(0, 5, 300)
    vectors = spark.createDataFrame([(k, [float(x) for x in v[k]], int(cells[k])) for k in range(300)] + [(900, None, 1)], "doc_id long, v array<double>, cell int").repartition(3)
    c = np.array([v[cells == k].mean(axis=0) for k in range(5)])
    centers = spark.createDataFrame([(k, [float(x) for x in c[k]]) for k in range(5)], "cell int, c array<double>")
    queries = vectors.where("doc_id % 10 = 0 and doc_id < 300").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    found = probe(vectors, queries, centers, 7, 2, "l2")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = set()
    for q in range(0, 300, 10):
        near = sorted(range(5), key=lambda k: (round(float(np.linalg.norm(c[k] - v[q])), 6), k))[:2]
        best = sorted((round(float(np.linalg.norm(v[k] - v[q])), 6), k) for k in range(300) if cells[k] in near)[:7]
        want |= {(q, k, s, i + 1) for i, (s, k) in enumerate(best)}
    assert {(r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in found.collect()} == want


def best_links(asked, names, threshold):
    grams = {s: {s[i : i + 3] for i in range(len(s) - 2)} for s in [*asked, *names]}
    out = set()
    for m in asked:
        near = [(-round(j, 6), n) for n in names if (j := len(grams[m] & grams[n]) / len(grams[m] | grams[n])) >= threshold]
        out |= {(m, min(near)[1], -min(near)[0])} if near else set()
    return out


def links_of(spark, asked, names, threshold):
    rows = graph.link(spark.createDataFrame(list(enumerate(asked)), "query_id long, mention string"), spark.createDataFrame([(n,) for n in names], "entity string"), threshold).collect()
    return {(r["mention"], r["entity"], round(r["similarity"], 6)) for r in rows}


def test_names_one_gram_apart_make_no_pairs(spark, monkeypatch):
    """Numbered names with a sign after them, among them some with equal sets of grams: nothing meets by a rare gram."""
    monkeypatch.setattr(graph, "candidates", None)
    names = [f"customer#{k:09d}" for k in [*range(90, 130), *range(990, 1020), 1111, 11111, 20000, *range(100000, 100100, 7)]]
    asked = [n + "#" for n in names] + [n[1:] for n in names[::5]] + names[::7]
    assert links_of(spark, asked, names, 0.8) == best_links(asked, names, 0.8)


def test_names_further_apart(spark):
    """Mentions that are equal, one gram and several grams away from the nearest name, or from all too many."""
    draw = random.Random(8)
    names = ["".join(draw.choice("abc") for _ in range(draw.randint(6, 14))) for _ in range(150)]
    asked = sorted({n[: draw.randint(3, 14)] + draw.choice(["", "a", "xy", "xyzxyz"]) for n in names})
    for threshold in (0.2, 0.6):
        want = best_links(asked, names, threshold)
        assert links_of(spark, asked, names, threshold) == want and len({s for _, _, s in want}) > 8


def test_names_are_not_sent_to_the_driver_when_they_look_small(spark):
    """Also as run, where rows of names are so few bytes in the shuffle that they could be sent around."""
    names = spark.range(300).select(F.concat(F.lit("customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("x"))
    pairs = graph.candidates(graph.gram_sets(names, "x"), graph.gram_sets(names.select(F.col("x").alias("y")), "y"), 0.9)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
