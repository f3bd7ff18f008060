"""Evaluation files, result tables, and small functions that strategies are built from."""

import json

import pytest
from pyspark.sql import functions as F

from siftspan.functions import text as T
from siftspan.functions import vector as V
from siftspan.operators import fusion, metrics
from siftspan.sources import evaluation
from siftspan.sources.vector_table import distance_expression


def test_samples_of_a_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"sample_id": "x", "query": "q", "answer": "a b", "contexts": ["a b"], "latency_seconds": 2.5}, {"query": "no id", "answer": "", "other": 1}]))
    rows = evaluation.read_samples(spark, f"file://{tmp_path}/s.json")
    got = {r["query"]: r for r in rows.collect()}
    assert got["q"]["sample_id"] == "x" and got["no id"]["contexts"] == [] and len(got["no id"]["sample_id"]) == 16 and got["no id"]["ground_truth"] is None
    scores = metrics.evaluate(rows, ("faithfulness", "latency_score"))
    means = evaluation.strategy_table({"one": scores, "two": scores})
    assert {(r["strategy"], r["metric"]): r["mean_score"] for r in means.collect()}["two", "faithfulness"] == 0.5
    wide = evaluation.radar_table(means)
    assert wide.columns == ["metric", "one", "two"] and wide.count() == 2


def test_frontier_line(spark):
    p = spark.createDataFrame([(1, 0.9, 5.0), (2, 0.5, 1.0), (3, 0.7, 3.0), (4, 0.6, 4.0)], "point_id long, quality double, latency double")
    assert [r["point_id"] for r in evaluation.frontier_by(p, ["quality", "latency"], ("latency",), "latency").orderBy("place").collect()] == [2, 3, 1]


def test_invented_texts_and_their_queries(spark):
    made = evaluation.invented(spark, ["oak", "elm", "ash"], 50, 3, 6, seed=4)
    rows = sorted(map(tuple, made.collect()))
    assert rows == sorted(map(tuple, made.repartition(7).collect())) and len(rows) == 50
    assert {len(t.split()) for _, t in rows} == {3, 4, 5, 6} and {w for _, t in rows for w in t.split()} == {"oak", "elm", "ash"}
    assert len({t for _, t in evaluation.invented(spark, ["oak", "elm", "ash"], 50, 3, 6, seed=5).collect()} & {t for _, t in rows}) < 25
    asked = evaluation.excerpts(made, 10, 2).collect()
    texts = dict(rows)
    assert len(asked) == 10 and all(r["query"] in texts[r["query_id"]] and len(r["query"].split()) == 2 for r in asked)
    assert evaluation.excerpts(spark.createDataFrame([(1, None), (2, " "), (3, "one")], "doc_id long, text string"), 10, 4).collect()[0]["query"] == "one"
    with pytest.raises(ValueError):
        evaluation.invented(spark, [], 5, 1, 2)


def test_table_definition():
    made = evaluation.table_definition("docs", 64, "l2", "ivfflat", 10)
    assert "vector(64)" in made[1] and "vector_l2_ops" in made[2] and "lists = 10" in made[2] and len(evaluation.table_definition("docs", 3, index="")) == 2
    with pytest.raises(ValueError):
        evaluation.table_definition("docs; drop", 3)


def test_small_functions(spark):
    row = spark.createDataFrame([("so [DONE] it is", "go on", [3.0, 4.0], [4.0, 3.0])], "a string, b string, x array<double>, y array<double>")
    got = row.select(T.says_done(F.col("a")), T.says_done(F.col("b")), T.cache_key(F.col("b")), *[distance_expression(m, F.col("x"), F.col("y")) for m in ("cosine", "dot", "l2")], *[V.similarity(m, distance_expression(m, F.col("x"), F.col("y"))) for m in ("cosine", "dot", "l2")]).first()
    assert got[0] and not got[1] and len(got[2]) == 64
    assert list(got)[3:] == pytest.approx([0.04, -24.0, 2**0.5, 0.96, 24.0, 1 / (1 + 2**0.5)])


def test_saturated_weights_and_last_values(spark):
    logits = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", -2.0), (2, "b", 0.5)], "doc_id long, token string, logit double")
    got = {(r["doc_id"], r["token"]): r["weight"] for r in fusion.saturate(logits, "doc_id").collect()}
    assert got == {(1, "a"): pytest.approx(1.3862943611), (2, "b"): pytest.approx(0.4054651081)}
    rows = spark.createDataFrame([("k", n, f"v{n}") for n in range(5)], "key string, n int, v string")
    assert fusion.last_n(rows, "key", "n", 3, "v").first()["values"] == ["v2", "v3", "v4"]
    docs = spark.createDataFrame([(1, "a", 2.0), (2, "a", 1.0), (2, "b", 4.0)], "doc_id long, token string, weight double")
    queries = spark.createDataFrame([(7, "a", 1.0), (7, "b", 0.5)], "query_id long, token string, weight double")
    assert [tuple(r) for r in fusion.sparse_search(docs, queries, 2).orderBy("rank").collect()] == [(7, 2, 1.0, 1), (7, 1, pytest.approx(0.666667), 2)]
