"""Retrieval operators on small literal tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftspan.functions.vector import embed, hashed_vectors
from siftspan.functions import text as T
from siftspan.operators import blocks, bm25, dense, fusion, graph, iterative, tuning
from siftspan.operators.topk import topk
from siftspan.plans.pipeline import Config, Pipeline
from siftspan.sources.providers import Completer, Embedder, Options, messages
from siftspan.sources.vector_table import VectorTable

TEXTS = ["machine learning is a field of machine study", "deep learning uses networks", "the cat sat on the mat", "learning to cook", "networks of roads"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(1, "machine learning"), (2, "networks networks"), (3, "zebra")], "query_id long, query string")


def model_bm25(q, k1=1.5, b=0.75):
    toks = [t.split() for t in TEXTS]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    out = {}
    for i, t in enumerate(toks):
        s = 0.0
        for w in q.split():
            df = sum(w in x for x in toks)
            tf = t.count(w)
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
        out[i] = s
    best = max(out.values())
    return {i: round(s / best, 6) for i, s in out.items() if s > 0}


def test_bm25(spark, docs, queries):
    rows = bm25.retrieve(docs, queries, 10).collect()
    for q, text in ((1, "machine learning"), (2, "networks networks")):
        assert {r["doc_id"]: r["score"] for r in rows if r["query_id"] == q} == pytest.approx(model_bm25(text))
    assert not [r for r in rows if r["query_id"] == 3]
    assert all(r["score"] >= 0.5 for r in bm25.retrieve(docs, queries, 10, threshold=0.5).collect())
    assert bm25.retrieve(docs.limit(0), queries, 5).count() == 0
    with pytest.raises(ValueError):
        topk(docs, 0)


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, None)], "doc_id long, v array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, q array<double>")
    got = [(r["doc_id"], r["score"]) for r in dense.search(v, q, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, pytest.approx(0.707107)), (2, 0.0)]
    assert [r["doc_id"] for r in dense.search(v, q, 2, "l2").orderBy("rank").collect()] == [1, 4]
    assert [r["doc_id"] for r in dense.search(v, q, 1, "dot").collect()] == [3]


def test_embedders_agree(spark, docs):
    a = {r["doc_id"]: r["v"] for r in hashed_vectors(docs, ["doc_id"], "text").collect()}
    b = {r["doc_id"]: r["v"] for r in docs.select("doc_id", embed(F.col("text")).alias("v")).collect()}
    for k in a:
        assert a[k] == pytest.approx(b[k])


def test_rrf(spark, docs, queries):
    one, two = (bm25.retrieve(docs, queries, 10, k1=k) for k in (1.5, 2.0))
    rows = fusion.rrf([(one, "a", 0.5), (two, "b", 0.5)], 5).collect()
    assert rows and max(r["score"] for r in rows) == 1.0
    with pytest.raises(ValueError):
        fusion.rrf([])


def test_max_sim(spark):
    d = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [0.6, 0.8])], "doc_id long, i int, v array<double>")
    q = spark.createDataFrame([(9, 0, [1.0, 0.0]), (9, 1, [0.0, 1.0])], "query_id long, qi int, q array<double>")
    got = {r["doc_id"]: r["score"] for r in fusion.max_sim(d, q, 5).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.7})


def test_graph(spark, docs):
    t = spark.createDataFrame([("Paris", "in", "France", 1), ("France", "in", "Europe", 2), ("Berlin", "in", "Germany", 3), ("", "in", "x", 4)], "subject string, predicate string, object string, doc_id long")
    m = spark.createDataFrame([(1, "paris"), (2, "nothing like it")], "query_id long, mention string")
    q = spark.createDataFrame([(1, "where is paris"), (2, "the cat")], "query_id long, query string")
    rows = graph.retrieve(spark, q, m, t, docs, 5, 2).orderBy("query_id", "rank").collect()
    assert [(r["doc_id"], r["score"]) for r in rows if r["query_id"] == 1] == [(1, 1.0), (2, 0.5)]
    assert [(r["doc_id"], r["score"]) for r in rows if r["query_id"] == 2][0] == (2, 1.0)


def test_rounds(spark, docs, queries):
    search = lambda q, k: bm25.retrieve(docs, q, k)
    hop = iterative.multi_hop(spark, queries, docs, search, F.concat_ws(" ", "query", F.lit("cat mat")), F.lit(False), 10, 2, 2).collect()
    assert {r["step"] for r in hop} == {0, 1} and all(r["score"] <= 0.9 + 1e-9 for r in hop if r["step"] == 1)
    cot = iterative.interleaved(spark, queries, docs, search, F.col("query"), F.lit(True), 10, 4, 2).collect()
    assert {r["step"] for r in cot} == {0}
    judge = F.struct(F.lit(True).alias("is_relevant"), (F.col("doc_id") != 1).alias("is_supported"), F.lit(True).alias("is_useful"), F.lit(0.5).alias("confidence"))
    kept = iterative.self_reflective(spark, queries, docs, search, judge, F.col("query"), F.lit(True), 3, 2).collect()
    assert kept and all(r["doc_id"] != 1 and r["score"] <= 0.5 for r in kept)


def test_notes_and_rerank(spark, docs, queries):
    hits = bm25.retrieve(docs, queries, 10)
    kind = F.when(F.col("doc_id") == 1, "conflicting").when(F.col("doc_id") == 3, "complementary").otherwise("standard")
    note = F.struct(F.when(F.col("doc_id") == 0, "relevant").when(F.col("doc_id") == 1, "partially_relevant").otherwise("irrelevant").alias("relevance"), kind.alias("note_type"))
    first = {r["doc_id"]: r["score"] for r in hits.where("query_id = 1").collect()}
    got = {r["doc_id"]: r["score"] for r in iterative.noted(hits, queries, docs, note, 5).where("query_id = 1").collect()}
    want = {0: min(1, first[0] * 1.2), 1: first[1] * 0.8 - 0.05, 3: first[3] * 0.2 + 0.1}
    assert got == pytest.approx({k: max(0, v) for k, v in want.items()}, abs=1e-6)
    again = fusion.rerank(hits, queries, docs, -F.length("text") / 10, 2).where("query_id = 1").orderBy("rank").collect()
    assert again[0]["doc_id"] == 3


def test_chain_of_notes(spark, docs, queries):
    """Requests of two documents each, replayed by a function that looks at what it is asked."""
    hits = bm25.retrieve(docs, queries, 4)
    asked = spark.sparkContext.accumulator(0)

    def call(request):
        asked.add(1)
        p = request["prompt"]
        if "Noted so far" in p:
            assert "0 / relevant / first" in p or "4 / relevant / first" in p or "1 / " in p
            return {"content": "RELEVANCE: irrelevant\nTYPE: complementary", "prompt_tokens": len(p)}
        return "RELEVANCE: relevant\nKEY_INFO: first\n\nno note here"

    got = iterative.chain_of_notes(spark, hits, queries, docs, Completer(call=call), 10, 2).orderBy("query_id", "rank").collect()
    mine = {r["doc_id"]: r for r in got if r["query_id"] == 1}
    order = [r["doc_id"] for r in hits.where("query_id = 1").orderBy("rank").collect()]
    assert mine[order[0]]["relevance"] == "relevant" and mine[order[0]]["key_info"] == "first" and mine[order[0]]["score"] == 1.0
    assert mine[order[1]]["relevance"] == "partially_relevant" and mine[order[1]]["score"] == pytest.approx(mine[order[1]]["original_score"] * 0.8, abs=1e-6)
    assert mine[order[2]]["relevance"] == "irrelevant" and mine[order[2]]["note_type"] == "complementary" and mine[order[2]]["score"] == pytest.approx(mine[order[2]]["original_score"] * 0.2 + 0.1, abs=1e-6)
    assert iterative.chain_of_notes(spark, hits.where("false"), queries, docs, Completer(call=call)).count() == 0


def test_completer(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "b", None), (4, None, "s"), (5, "boom", ""), (6, "late", "")], "id long, prompt string, system string")
    log = tmp_path / "calls"
    log.mkdir()

    def call(request):
        (log / f"{request['prompt']}-{len(list(log.iterdir()))}-{id(request)}").touch()
        if request["prompt"] == "boom":
            raise ValueError("no answer")
        if request["prompt"] == "late" and len([p for p in log.iterdir() if p.name.startswith("late")]) < 2:
            raise TimeoutError
        return {"content": f"{request['system']}:{request['prompt']}:{request['temperature']}", "total_tokens": 7, "model": None}

    got = {r["id"]: r for r in Completer(call=call, options=Options(model="m"), retries=1, wait=0.0).complete(rows, system="system", temperature=0.5).collect()}
    assert [got[k]["response"]["content"] for k in (1, 2, 3, 4, 5, 6)] == ["s:a:0.5", "s:a:0.5", ":b:0.5", "", "", ":late:0.5"]
    assert got[1]["response"]["total_tokens"] == 7 and got[1]["response"]["prompt_tokens"] == 0 and got[1]["response"]["model"] == "m" and got[4]["response"]["total_tokens"] == 0
    assert got[5]["response_error"] == "ValueError: no answer" and got[1]["response_error"] is None
    assert sum(p.name.startswith("a-") for p in log.iterdir()) == 1 and sum(p.name.startswith("boom") for p in log.iterdir()) == 2
    replay = spark.createDataFrame([("a", "A"), ("b", None)], "p string, content string").select(T.cache_key(F.col("p")).alias("prompt_key"), "content")
    assert {r["id"]: r["response"]["content"] for r in Completer(replay=replay).complete(rows).collect()} == {1: "A", 2: "A", 3: "", 4: "", 5: "", 6: ""}
    assert Completer(rule=F.upper).complete(rows).where("id = 3").first()["response"]["content"] == "B"
    with pytest.raises(ValueError):
        Completer().complete(rows)
    m = spark.createDataFrame([("p", "s"), ("p", None), ("p", "")], "p string, s string").select(messages(F.col("p"), F.col("s")).alias("m")).collect()
    assert [[(x["role"], x["content"]) for x in r["m"]] for r in m] == [[("system", "s"), ("user", "p")], [("user", "p")], [("user", "p")]]


def test_embedder(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None), (5, "three")], "k long, text string")
    log = tmp_path / "texts"
    log.mkdir()

    def call(texts):
        for t in texts:
            (log / f"{t}-{len(list(log.iterdir()))}").touch()
        return [[float(len(t)), 4.0] for t in texts]

    got = {r["k"]: r["v"] for r in Embedder(2, call=call).encode(rows, ["k"], "text").collect()}
    assert got == {1: [0.6, 0.8], 2: [0.6, 0.8], 3: [0.6, 0.8], 5: pytest.approx([5 / 41**0.5, 4 / 41**0.5])} and len(list(log.iterdir())) == 3
    known = spark.createDataFrame([("two", [3.0, 0.0])], "t string, v array<double>").select(T.cache_key(F.col("t")).alias("text_key"), "v")
    assert [tuple(r) for r in Embedder(2, known=known).encode(rows, ["k"], "text").collect()] == [(2, [1.0, 0.0])]
    assert {r["k"] for r in Embedder().encode(rows, ["k"], "text").collect()} == {1, 2, 3, 5}


def test_block_search_is_the_join(spark, monkeypatch):
    """Many queries in several blocks, ties at the edge, common terms, strings as ids: the same rows as the index join."""
    draw = random.Random(3)
    docs = spark.createDataFrame([(f"d{k:03}", " ".join(draw.choice("abcdefghij") for _ in range(draw.randint(0, 12)))) for k in range(150)] + [("null", None)], "doc_id string, text string").repartition(5)
    queries = spark.createDataFrame([(k, " ".join(draw.choice("abcdefghijz") for _ in range(draw.randint(0, 4)))) for k in range(40)], "query_id long, query string")

    def all_of():
        return [sorted(map(tuple, f.collect()), key=str) for f in (bm25.retrieve(docs, queries, 7), fusion.log_tf_search(docs, queries, 5), graph.overlap(queries, docs, 6), tuning.bm25_grid(spark, docs, queries, [(3, 1.2, 0.7), (4, 0.9, 0.2)], 4))]

    whole = all_of()
    monkeypatch.setattr(blocks, "BLOCK", 9)
    monkeypatch.setattr(blocks, "CELLS", 40)
    assert all_of() == whole
    monkeypatch.setattr(blocks, "MAX_BLOCKS", 1)
    assert all_of() == whole and all(whole)
    assert bm25.retrieve(docs, queries.where("false"), 3).count() == 0 and graph.overlap(queries.where("false"), docs, 3).count() == 0


def test_max_sim_blocks(spark, monkeypatch):
    rng = random.Random(4)
    d = [(k % 13, k, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for k in range(90)]
    q = [(k % 5, k, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for k in range(17)]
    dv, qv = spark.createDataFrame(d, "doc_id long, i long, v array<double>").repartition(3), spark.createDataFrame(q, "query_id long, qi long, q array<double>")
    raw = {(a, b): sum(max(sum(x * y for x, y in zip(v, u, strict=True)) for i, _, v in d if i == b) for j, _, u in q if j == a) for a in range(5) for b in range(13)}
    want = []
    for a in range(5):
        best = max(raw[a, b] for b in range(13))
        ranked = sorted(((-round(raw[a, b] / best if best > 0 else raw[a, b], 6), b) for b in range(13)))[:4]
        want += [(a, b, pytest.approx(-s, abs=1.1e-6), r + 1) for r, (s, b) in enumerate(ranked)]
    assert sorted(map(tuple, fusion.max_sim(dv, qv, 4).collect()), key=lambda r: (r[0], r[3])) == want
    monkeypatch.setattr(fusion, "TOKENS", 4)
    monkeypatch.setattr(fusion, "PRODUCTS", 20)
    assert sorted(map(tuple, fusion.max_sim(dv, qv, 4).collect()), key=lambda r: (r[0], r[3])) == want


def test_vector_table(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    t = VectorTable(spark, where, "cosine", 2)
    rows = spark.createDataFrame([("a", [2.0, 0.0], {"k": "1"}), ("b", [0.0, 1.0], {"k": "2"}), ("z", [0.0, 0.0], {})], "id string, vector array<double>, metadata map<string,string>")
    assert t.count() == 0
    t.add(rows)
    t.add(spark.createDataFrame([("a", [1.0, 1.0], {"k": "2"})], rows.schema))
    assert t.count() == 3
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, q array<double>")
    assert [r["doc_id"] for r in t.search(q, 2, {"k": "2"}).orderBy("rank").collect()] == ["b", "a"]
    assert t.search(q, 1, {"k": "1"}, post_filter=True).count() == 0
    t.delete(spark.createDataFrame([("b",), ("no",)], "id string"))
    assert t.count() == 2
    # Opened again, it is as it was; opened as another kind of table, it is an error.
    again = VectorTable(spark, where)
    assert (again.metric, again.dimension) == ("cosine", 2) and {r["id"] for r in again.rows().collect()} == {"a", "z"}
    with pytest.raises(ValueError):
        VectorTable(spark, where, "l2")
    again.add(spark.createDataFrame([("b", [1.0, 0.0], {}), ("b", [0.0, 1.0], {"n": "2"})], rows.schema), "append")
    again.add(spark.createDataFrame([("b", [0.0, 1.0], {"n": "3"})], rows.schema), "append")
    assert again.count() == 5 and t.count() == 5
    newest = spark.createDataFrame([("b", [1.0, 0.0], {}, 1), ("b", [0.0, 1.0], {"n": "9"}, 2)], "id string, vector array<double>, metadata map<string,string>, at int")
    again.add(newest, order="at")
    assert [r["metadata"] for r in again.rows().where("id = 'b'").collect()] == [{"n": "9"}]
    before = sorted(map(str, again.rows().collect()))
    again.compact()
    assert sorted(map(str, t.rows().collect())) == before and len(again._segments()) == 1
    for k in range(20):
        again.add(spark.createDataFrame([(f"m{k}", [1.0, float(k)], {})], rows.schema))
    assert again.count() == 23 and len(again._segments()) <= VectorTable.MOST + 1
    t.save(f"file://{tmp_path}/s")
    u = VectorTable(spark, f"file://{tmp_path}/u")
    u.load(f"file://{tmp_path}/s")
    assert u.count() == 23
    with pytest.raises(ValueError):
        t.add(spark.createDataFrame([("c", [1.0], {})], rows.schema))
    with pytest.raises(ValueError):
        VectorTable(spark, f"file://{tmp_path}/w", "manhattan")


def test_clustered_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"v{k}", [rng.gauss(c, 0.05), rng.gauss(1 - c, 0.05)], {}) for k, c in enumerate([0.0, 1.0] * 30)]
    schema = "id string, vector array<double>, metadata map<string,string>"
    t = VectorTable(spark, f"file://{tmp_path}/ivf", "l2", 2, nlist=2, nprobe=1)
    t.add(spark.createDataFrame([("early", [0.0, 1.01], {})], schema))
    t.add(spark.createDataFrame(rows, schema))
    t.add(spark.createDataFrame([("late", [1.0, 0.01], {})], schema))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, q array<double>")
    got = {}
    for r in VectorTable(spark, f"file://{tmp_path}/ivf").search(q, 5).collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    exact = {}
    for r in dense.search(t.rows().select(F.col("id").alias("doc_id"), F.col("vector").alias("v")), q, 5, "l2").collect():
        exact.setdefault(r["query_id"], set()).add(r["doc_id"])
    cells = {r["id"]: r["cell"] for r in t.rows().collect()}
    assert cells["early"] is None and cells["late"] == cells["v1"] != cells["v0"] and got == exact and "late" in got[1] and "early" in got[2]


def test_lengths_of_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 2.0, 3.0])], "doc_id long, v array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, q array<double>")
    with pytest.raises(Exception, match="components"):
        dense.search(v, q, 3).collect()


@pytest.mark.parametrize("chunker", ["fixed", "recursive", "semantic", "document_aware"])
def test_pipeline(spark, docs, chunker):
    p = Pipeline(spark, Config(chunker=chunker, chunk_size=64, chunk_overlap=0))
    assert p.ingest(docs) > 0 and p.documents == 5
    scores = p.evaluate(spark.createDataFrame([(1, "machine learning", "a field")], "query_id long, query string, ground_truth string")).collect()
    assert len(scores) == 8 and all(0 <= r["score"] <= 1 for r in scores)


def test_graph_ranks_few_documents(spark, monkeypatch):
    """Against all pairs of a query and a document: the same k best, of no more rows than entities of a depth have."""
    rnd, given, rank = random.Random(3), [], graph.topk
    monkeypatch.setattr(graph, "topk", lambda scored, *a, **b: given.append(scored.count()) or rank(scored, *a, **b))
    reached = [(q, f"e{n}", rnd.randrange(3)) for q in range(6) for n in rnd.sample(range(40), 12)] + [(7, "hub", 1), (7, "deep", 2), (8, "deep", 2)]
    docs = [(f"e{rnd.randrange(40)}", rnd.randrange(60)) for _ in range(150)] + [("hub", n) for n in range(300)] + [("deep", n) for n in range(100, 900)]
    docs = sorted(set(docs))
    got = graph.scored_docs(spark.createDataFrame(reached, "query_id long, entity string, depth int"), spark.createDataFrame(docs, "entity string, doc_id long"), 4)
    assert given[0] <= 6 * 12 * 4 + 4 + 4
    want = set()
    for q in {q for q, _, _ in reached}:
        depth = {}
        for _, e, n in (r for r in reached if r[0] == q):
            for _, doc in (d for d in docs if d[0] == e):
                depth[doc] = min(n, depth.get(doc, n))
        best = sorted((n, doc) for doc, n in depth.items())[:4]
        want |= {(q, doc, round((1 + best[0][0]) / (1 + n), 6), k) for k, (n, doc) in enumerate(best, 1)}
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in got.collect()} == want
