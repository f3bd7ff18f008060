"""Metrics, comparisons, Pareto analysis, search and synthesis on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from siftspan.functions import distributions as D
from siftspan.operators import abtest, metrics, pareto, synthesis, tuning

SAMPLE = "sample_id string, query string, answer string, contexts array<string>, ground_truth string, latency_seconds double"


def scores(spark, *rows):
    out = {}
    for r in metrics.evaluate(spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], SAMPLE)).collect():
        out.setdefault(int(r["sample_id"]), {})[r["metric"]] = r["score"]
    return out


def test_metrics(spark):
    got = scores(spark, ("q", "the sky is blue", ["the sky is blue"], "the sky is blue", 5.0), ("q", "alpha", ["beta"], None, None), ("", "", [], None, 0.0), ("a b", "One. Two.", ["a b", "zz"], None, 10.0))
    assert got[0]["faithfulness"] == 1.0 and got[0]["context_recall"] == 1.0 and got[0]["answer_correctness"] == 1.0 and got[0]["latency_score"] == 0.5 and got[0]["coherence"] == 1.0
    assert got[1]["faithfulness"] == 0.0 and got[1]["context_recall"] == 0.0 and got[1]["answer_correctness"] == 0.0 and got[1]["latency_score"] == 0.0
    assert got[2]["coherence"] == 0.0 and got[2]["latency_score"] == 1.0
    assert got[3]["context_relevance"] == 0.5 and got[3]["context_precision"] == 0.5 and got[3]["latency_score"] == 0.0
    assert all(0 <= v <= 1 for r in got.values() for v in r.values())


def test_ragas(spark):
    rows = spark.createDataFrame([("1", "a", 0.5), ("1", "b", 0.0), ("1", "c", 1.0)], "sample_id string, metric string, score double")
    assert metrics.harmonic(rows).first()["overall"] == pytest.approx(2 / 3)
    c = spark.createDataFrame([("1", ["x yes", "no"]), ("2", [])], "sample_id string, claims array<string>")
    assert {r["sample_id"]: r["score"] for r in metrics.judged_faithfulness(c, F.col("claim")).collect()} == {"1": 0.5, "2": 1.0}


def test_distributions(spark):
    t = spark._jvm.org.apache.commons.math3.distribution.TDistribution
    for df in (1.0, 3.5, 10.0, 58.0):
        for x in (0.1, 1.0, 2.5, 7.0):
            assert D.t_two_sided(x, df) == pytest.approx(2 * t(df).cumulativeProbability(-x), rel=1e-8)
        assert D.t_quantile(0.975, df) == pytest.approx(t(df).inverseCumulativeProbability(0.975), rel=1e-6)
    assert D.mann_whitney_exact(0, 3, 3) == pytest.approx(0.1)


def arms(spark, a, b):
    return spark.createDataFrame([("m", "A", k, float(x)) for k, x in enumerate(a)] + [("m", "B", k, float(x)) for k, x in enumerate(b)], "metric string, arm string, pos long, score double")


def test_comparisons(spark):
    draw = random.Random(42)
    a, b = [draw.gauss(0.7, 0.1) for _ in range(30)], [draw.gauss(0.8, 0.1) for _ in range(30)]
    data = arms(spark, a, b)
    diff = sum(a) / 30 - sum(b) / 30
    w = abtest.welch(data).first()
    # All signs are those of A - B: effect, statistic and the interval around the difference.
    assert diff < 0 and w["effect_size"] < 0 and w["statistic"] < 0 and w["p_value"] < 0.05 and w["winner"] == "B"
    assert (w["ci_lo"] + w["ci_hi"]) / 2 == pytest.approx(diff) and w["ci_hi"] < 0
    u = abtest.mann_whitney(data).first()
    assert u["statistic"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert (u["ci_lo"], u["ci_hi"]) == pytest.approx((w["ci_lo"], w["ci_hi"]))
    p = abtest.paired(data).first()
    assert p["p_value"] < 0.05 and p["statistic"] < 0 and p["ci_lo"] < p["mean_diff"] < p["ci_hi"] < 0 and p["mean_diff"] == pytest.approx(diff)
    same = abtest.permutation(spark, arms(spark, a, [x + 1e-4 for x in reversed(a)]), 200).first()
    assert same["p_value"] > 0.01
    far = abtest.permutation(spark, data, 2000).first()
    assert far["observed"] == pytest.approx(diff, abs=1e-6) and far["p_value"] < 0.01 and far["ci_lo"] < 0 < far["ci_hi"]
    flat = abtest.welch(arms(spark, [0.5] * 30, [0.5] * 30)).first()
    assert not flat["significant"] and flat["effect_size"] == 0.0
    for test in (abtest.welch, abtest.mann_whitney):
        r = test(arms(spark, [0.5], [0.9, 0.8])).first()
        assert (r["statistic"], r["p_value"], r["ci_lo"], r["ci_hi"]) == (0.0, 1.0, 0.0, 0.0)


def test_permutation_of_many_scores_is_the_same(spark, monkeypatch):
    draw = random.Random(1)
    data = arms(spark, [draw.random() for _ in range(15)], [draw.random() + 0.2 for _ in range(20)])
    want = abtest.permutation(spark, data, 60).first()
    monkeypatch.setattr(abtest, "SEND_ROWS", 0)
    assert abtest.permutation(spark, data, 60).first() == want


def test_compare(spark):
    rows = [[(str(k), "the tide", f"the tide is {x} {k}", ["the tide is high"], "the tide is high", 1.0) for k in range(12)] for x in ("high", "odd low")]
    a, b = (spark.createDataFrame(r, SAMPLE) for r in rows)
    for test in ("welch_t", "mann_whitney_u", "bootstrap", "paired_t"):
        got = {r["metric"]: r for r in abtest.compare(spark, a, b, test, ("faithfulness", "latency_score"), rounds=300).collect()}
        assert got["faithfulness"]["winner"] == "Pipeline A" and got["faithfulness"]["alpha"] == 0.025 and got["latency_score"]["winner"] is None
        assert got["faithfulness"]["num_samples"] == 24 and got["faithfulness"]["test"] == test and got["faithfulness"]["statistic"] > 0


def test_pareto(spark):
    # Two on the frontier are alike; the best sum of all points would be that of a dominated one, were it let in.
    p = spark.createDataFrame([("k", 4.0, 1.0), ("l", 3.0, 6.0), ("m", 1.0, 9.0), ("n", 3.0, 5.5), ("o", 4.0, 1.0), ("p", 0.5, 0.5)], "point_id string, gain double, cost double")
    got = {r["point_id"]: (r["n_dominating"], r["is_optimal"]) for r in pareto.frontier(p, ["gain", "cost"], ("cost",)).collect()}
    assert got == {"k": (0, True), "l": (3, False), "m": (4, False), "n": (2, False), "o": (0, True), "p": (0, True)}
    assert {r["point_id"] for r in pareto.optimal(p, ["gain", "cost"], ("cost",)).collect()} == {"k", "o", "p"}
    assert pareto.suggest(p, {"gain": 0.1, "cost": 0.9}, minimise=("cost",)).first()["point_id"] == "k"
    three = p.withColumn("third", F.col("gain") * 0)
    assert {r["point_id"] for r in pareto.optimal(three, ["gain", "cost", "third"], ("cost",)).collect()} == {"k", "o", "p"}
    q = spark.createDataFrame([(k, float(k), float(10 - k)) for k in range(5)], "point_id long, x double, y double")
    c = {r["point_id"]: r["crowding_distance"] for r in pareto.crowding(q, ["x", "y"]).collect()}
    assert c == {0: None, 4: None, 1: 1.0, 2: 1.0, 3: 1.0}


def test_pareto_analysis(spark):
    p = spark.createDataFrame([(1, 0.0, 9.0), (2, 1.0, 8.0), (3, 5.0, 5.0), (4, 9.0, 0.0), (5, 4.0, 4.0)], "point_id long, x double, y double")
    got = {r["point_id"]: r for r in pareto.analyse(p, ["x", "y"]).collect()}
    assert [got[k]["frontier_rank"] for k in (1, 4, 3, 2, 5)] == [1, 2, 3, 4, None]
    assert got[5]["n_dominating"] == 1 and got[5]["crowding_distance"] == 0.0 and got[1]["crowding_distance"] is None
    assert got[3]["crowding_distance"] == pytest.approx(8 / 9 + 8 / 9, abs=1e-6)
    assert pareto.suggest(p, None, ["x", "y"]).first()["point_id"] == 1
    assert pareto.suggest(p.where("false"), None, ["x", "y"]).count() == 0


def test_search(spark, tmp_path):
    params = list(tuning.random_search(tuning.SPACE, 40, 1))
    assert params == list(tuning.random_search(tuning.SPACE, 40, 1)) and all(p["chunk_overlap"] <= p["chunk_size"] // 2 for p in params)
    for p in params:
        assert ("k1" in p) == (p["strategy"] == "bm25") == ("b" in p) and ("dense_weight" in p) == (p["strategy"] == "hybrid")
        assert 0.1 <= p.get("dense_weight", 0.5) <= 0.9 and 0.5 <= p.get("k1", 1) <= 3
    ran = []

    def objective(p):
        ran.append(p["x"])
        if p["x"] == 3:
            raise ValueError("no")
        return p["x"]

    trials = tuning.optimise(spark, objective, tuning.grid({"x": (1, 2, 3)}))
    assert tuning.best(trials).first()["number"] == 1 and tuning.best(trials, False).first()["number"] == 0
    assert [r["state"] for r in trials.orderBy("number").collect()] == ["complete", "complete", "pruned"]
    # A study goes on from the trials that are stored, and no trial begins after its time.
    ran.clear()
    where = f"file://{tmp_path}/trials"
    tuning.optimise(spark, objective, tuning.grid({"x": (5, 6, 7, 8)}), where, n_trials=2)
    again = tuning.optimise(spark, objective, tuning.grid({"x": (5, 6, 7, 8)}), where).orderBy("number").collect()
    assert ran == [5, 6, 7, 8] and [r["value"] for r in again] == [5.0, 6.0, 7.0, 8.0] and spark.read.parquet(where).count() == 4
    assert tuning.optimise(spark, objective, tuning.grid({"x": (1,)}), timeout=0.0).count() == 0


def test_parzen_finds_more_than_chance(spark):
    def value(p):
        return (p["strategy"] == "bm25") + (p["chunk_size"] == 256) - abs(p.get("k1", 9.0) - 1.2) - abs(p.get("b", 9.0) - 0.4) - abs(p["top_k"] - 7) / 20

    found = []
    for seed in range(30):
        sampler, tried = tuning.Parzen(tuning.SPACE, seed), []
        for _ in range(60):
            p = sampler.propose(tried)
            tried.append((p, value(p)))
        found.append((max(v for _, v in tried), max(value(p) for p in tuning.random_search(tuning.SPACE, 60, seed))))
    assert sum(a > b for a, b in found) >= 18 and sum(a for a, _ in found) > sum(b for _, b in found) + 3
    trials = tuning.optimise(spark, value, tuning.Parzen(tuning.SPACE, 3), n_trials=15)
    again = tuning.optimise(spark, value, tuning.Parzen(tuning.SPACE, 3), n_trials=15)
    assert trials.count() == 15 and trials.collect() == again.collect()


def test_pipeline_objective(spark):
    docs = spark.createDataFrame([(1, "The tide rises at noon. Boats leave the harbour."), (2, "Bread is baked before dawn. The oven is hot.")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "tide harbour", "The tide rises")], "query_id long, query string, ground_truth string")
    objective = tuning.pipeline_objective(spark, docs, queries, "context_recall")
    params = [{"chunker": "fixed", "chunk_size": 64, "chunk_overlap": 0, "top_k": 3, "strategy": "bm25", "k1": 1.5, "b": 0.75}, {"chunker": "fixed", "chunk_size": 32, "top_k": 3, "strategy": "bm25"}]
    rows = tuning.optimise(spark, objective, iter(params)).orderBy("number").collect()
    assert rows[0]["value"] == 1.0 and rows[1]["state"] == "pruned"


def test_synthesis(spark):
    docs = spark.createDataFrame([(1, "text one"), (2, "text two")], "doc_id long, text string")
    asked = synthesis.requests(spark, docs, 3)
    assert asked.count() == 6
    answered = asked.withColumn("content", F.when(F.col("n") < 2, F.lit('ok {"question": "q", "answer": "a"}')).otherwise("broken"))
    assert synthesis.samples(answered).count() == 4 and synthesis.samples(answered, 3).count() == 3
    assert synthesis.adversarial(docs, 1).count() == 1
