"""Comparison of two arms of scores: moments in one aggregation, then closed forms; p-values on the rows of the result."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siftspan.functions import distributions as D
from siftspan.sources.tables import cut

FIELDS = "metric, n_a, n_b, mean_a, mean_b, std_a, std_b, effect_size, statistic, ci_lo, ci_hi"


def moments(scores: DataFrame) -> DataFrame:
    """A row a metric of `scores(metric, arm A or B, score)`: count, mean and sample deviation (0 under two) of each arm."""
    a, b = (F.when(F.col("arm") == x, F.col("score")) for x in "AB")
    return scores.groupBy("metric").agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("std_a"), F.coalesce(F.stddev_samp(b), F.lit(0.0)).alias("std_b"),
    )


def effect(rows: DataFrame) -> DataFrame:
    """Cohen's d of A over B with the pooled deviation: 0 for an arm of one, or if the deviation is under 1e-10."""
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("std_a") ** 2 + (F.col("n_b") - 1) * F.col("std_b") ** 2) / (F.col("n_a") + F.col("n_b") - 2))
    return rows.withColumn("effect_size", F.when((F.col("n_a") < 2) | (F.col("n_b") < 2), 0.0).when(pooled < 1e-10, 0.0).otherwise((F.col("mean_a") - F.col("mean_b")) / pooled))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([D.t_two_sided(a, b) for a, b in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def t_975(df: pd.Series) -> pd.Series:
    return pd.Series([D.t_quantile(0.975, x) for x in df])


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([D.normal_two_sided(x) for x in z])


def compare(spark: SparkSession, samples_a: DataFrame, samples_b: DataFrame, test: str = "welch_t", metrics: tuple[str, ...] | None = None, alpha: float = 0.05, bonferroni: bool = True, rounds: int = 10_000, name_a: str = "Pipeline A", name_b: str = "Pipeline B", **kwargs) -> DataFrame:
    """A row a metric: two sets of evaluation samples scored by `metrics.evaluate` and compared by the named test.

    test: welch_t, mann_whitney_u, bootstrap (permutation) or paired_t (samples pair by sample_id). The level is divided
    by the number of metrics with `bonferroni`. The winner is the name of the arm with the larger mean, if significant.
    """
    from siftspan.operators.metrics import evaluate

    rows = None
    for arm, samples in (("A", samples_a), ("B", samples_b)):
        one = (evaluate(samples, metrics, **kwargs) if metrics else evaluate(samples, **kwargs)).select("metric", F.lit(arm).alias("arm"), F.col("sample_id").alias("pos"), "score")
        rows = one if rows is None else rows.unionByName(one)
    if test == "welch_t":
        out = welch(rows, alpha, bonferroni)
    elif test == "mann_whitney_u":
        out = mann_whitney(rows, alpha, bonferroni)
    elif test in ("bootstrap", "paired_t"):
        found = permutation(spark, rows, rounds).withColumnRenamed("observed", "statistic") if test == "bootstrap" else paired(rows).drop("n", "mean_diff", "std_diff")
        out = _decide(effect(moments(rows)).join(found, "metric", "left").withColumn("p_value", F.coalesce("p_value", F.lit(1.0))), alpha, bonferroni, test)
    else:
        raise ValueError(f"no such test: {test}")
    return out.withColumn("winner", F.when(F.col("winner") == "A", name_a).when(F.col("winner") == "B", name_b)).withColumn("num_samples", F.col("n_a") + F.col("n_b")).withColumn("test", F.lit(test))


def _decide(rows: DataFrame, alpha: float, bonferroni: bool, test: str) -> DataFrame:
    level = F.lit(alpha) / F.count("*").over(W.partitionBy()) if bonferroni else F.lit(alpha)
    rows = rows.withColumn("alpha", level).withColumn("significant", F.coalesce(F.col("p_value") < F.col("alpha"), F.lit(False)))
    winner = F.when(F.col("significant"), F.when(F.col("mean_a") > F.col("mean_b"), "A").otherwise("B"))
    return rows.withColumn("winner", winner).withColumn("test", F.lit(test))


def _without_spread(diff: Column) -> Column:
    """The statistic of a difference without any spread: infinite, or null for none."""
    return F.when(diff > 0, float("inf")).when(diff < 0, float("-inf"))


def welch_statistic(scores: DataFrame) -> DataFrame:
    """Moments, effect, Welch's t of A against B and its degrees of freedom, and the pooled standard error."""
    va, vb = F.col("std_a") ** 2 / F.col("n_a"), F.col("std_b") ** 2 / F.col("n_b")
    rows = effect(moments(scores))
    small = (F.col("n_a") < 2) | (F.col("n_b") < 2)
    diff = F.col("mean_a") - F.col("mean_b")
    t = F.when(small, 0.0).when(va + vb > 0, diff / F.sqrt(va + vb)).otherwise(_without_spread(diff))
    df = F.when(va + vb > 0, (va + vb) ** 2 / (va**2 / (F.col("n_a") - 1) + vb**2 / (F.col("n_b") - 1))).otherwise(1.0)
    return rows.withColumn("statistic", t).withColumn("df", F.when(~small, df)).withColumn("se", F.sqrt(va + vb))


def _interval(rows: DataFrame) -> DataFrame:
    """ci_lo and ci_hi of mean A - mean B: 95 %, Welch's error (`se`), n_a + n_b - 2 degrees; 0 for an arm under two."""
    small = (F.col("n_a") < 2) | (F.col("n_b") < 2)
    half = t_975(F.greatest(F.col("n_a") + F.col("n_b") - 2, F.lit(1)).cast("double")) * F.col("se")
    diff = F.col("mean_a") - F.col("mean_b")
    return rows.withColumn("ci_lo", F.when(small, 0.0).otherwise(diff - half)).withColumn("ci_hi", F.when(small, 0.0).otherwise(diff + half))


def welch(scores: DataFrame, alpha: float = 0.05, bonferroni: bool = True) -> DataFrame:
    """Welch's t test a metric, with the interval of the mean difference; an arm under two gives 0, p 1 and (0, 0)."""
    rows = welch_statistic(scores)
    small = (F.col("n_a") < 2) | (F.col("n_b") < 2)
    rows = _interval(rows.withColumn("p_value", F.when(small, 1.0).otherwise(t_p("statistic", "df"))))
    return _decide(rows.drop("df", "se"), alpha, bonferroni, "welch_t")


def rank_sums(scores: DataFrame) -> DataFrame:
    """(metric, n_a, n_b, u, ties): U of A from average ranks, and the sum of t^3 - t over tied values."""
    # Values are counted first and sorted in ranges: a window runs over the distinct values of a range, and what lies
    # before it is a sum over the ranges, of which there are as many as partitions.
    values = scores.groupBy("metric", "score").agg(F.count_if(F.col("arm") == "A").alias("a"), F.count_if(F.col("arm") == "B").alias("b"))
    ranged = values.repartitionByRange("metric", "score").select("*", (F.col("a") + F.col("b")).alias("t"), F.spark_partition_id().alias("part"))
    ahead = lambda c, *by: F.coalesce(F.sum(c).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("metric", "part").agg(F.sum("t").alias("n")).select("metric", "part", ahead("n", "metric", "part").alias("base"))
    rows = ranged.select("*", ahead("t", "metric", "part", "score").alias("inner")).join(F.broadcast(parts), ["metric", "part"])
    rows = rows.withColumn("rank", F.col("base") + F.col("inner") + (F.col("t") + 1) / 2.0)
    sums = rows.groupBy("metric").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    return sums.select("metric", "n_a", "n_b", (F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2.0).alias("u"), "ties")


def mann_whitney(scores: DataFrame, alpha: float = 0.05, bonferroni: bool = True) -> DataFrame:
    """Two-sided U test: exact without ties where the smaller arm has 8 or fewer, else normal with corrections.

    The interval is that of the mean difference, as for Welch's test; an arm under two gives 0, p 1 and (0, 0).
    """
    @F.pandas_udf(DoubleType())
    def p(u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for u_, n_, m_, t_ in zip(u, n.astype(int), m.astype(int), ties, strict=True):
            total = n_ + m_
            if n_ < 2 or m_ < 2:
                out.append(1.0)
            elif t_ == 0 and min(n_, m_) <= 8 and n_ * m_ <= 4000:
                out.append(D.mann_whitney_exact(u_, n_, m_))
            else:
                var = n_ * m_ / 12 * (total + 1 - t_ / (total * (total - 1)))
                out.append(min(1.0, D.normal_two_sided(max(0.0, abs(u_ - n_ * m_ / 2) - 0.5) / var**0.5)) if var > 0 else 1.0)
        return pd.Series(out)

    small = (F.col("n_a") < 2) | (F.col("n_b") < 2)
    rows = welch_statistic(scores).drop("statistic", "df").join(rank_sums(scores).select("metric", F.col("u").alias("statistic"), "ties"), "metric")
    rows = _interval(rows.withColumn("p_value", p("statistic", "n_a", "n_b", "ties")).withColumn("statistic", F.when(small, 0.0).otherwise(F.col("statistic"))))
    return _decide(rows.drop("ties", "se"), alpha, bonferroni, "mann_whitney")


#: Fixed value: the prime of the rounds' hash.
PRIME = 2147483647
#: Scores that are sent to every task (16 bytes each); parts of an interval of keys in a pass of the selection; scores
#: of an interval that are looked at one by one; numbers that a task holds at once.
SEND_ROWS, PARTS, FEW, HELD = 1 << 20, 32, 64, 1 << 21


def permutation(spark: SparkSession, scores: DataFrame, rounds: int = 10_000, seed: int = 42, send_rows: int | None = None) -> DataFrame:
    """(metric, observed, p_value, ci_lo, ci_hi) of `scores(metric, arm, pos, score)`; differences are A - B.

    A round orders all scores of a metric by (a x + b) mod PRIME, with x from md5(seed, arm, pos) and a and b from
    md5(seed, round), then by arm and pos, and calls the first n_a of them A. p is the share of rounds with a difference
    as large as the observed one; the interval is that of the rounds' differences. Up to SEND_ROWS (or `send_rows`)
    scores (counted) are sent to tasks that share the rounds; more of them stay where they are, and each round's n_a-th key is selected.
    """
    number = lambda text, first: F.conv(F.substring(F.md5(text), first, 7), 16, 10).cast("long")
    dealt = scores.where(F.col("score").isNotNull()).select("metric", "arm", "pos", F.col("score").cast("double").alias("score"), number(F.concat_ws("-", F.lit(seed), F.col("arm"), F.col("pos")), 1).alias("x"))
    reps = spark.range(rounds).select(F.col("id").alias("rep"), (number(F.concat_ws("-", F.lit(seed), F.col("id")), 1) + 1).alias("a"), number(F.concat_ws("-", F.lit(seed), F.col("id")), 9).alias("b"))
    counts = dealt.groupBy("metric").agg(F.count_if(F.col("arm") == "A").alias("n_a"), F.count("*").alias("n"), F.sum("score").alias("total"), (F.avg(F.when(F.col("arm") == "A", F.col("score"))) - F.avg(F.when(F.col("arm") == "B", F.col("score")))).alias("observed")).where((F.col("n_a") > 0) & (F.col("n_a") < F.col("n")))
    if dealt.count() <= (SEND_ROWS if send_rows is None else send_rows):
        arrays = {name: (part["score"].to_numpy(), part["x"].to_numpy(), int((part["arm"] == "A").sum())) for name, part in dealt.toPandas().sort_values(["arm", "pos"], kind="stable").groupby("metric")}

        def run(batches):
            for batch in batches:
                rep, a, b = (batch.column(c).to_numpy() for c in ("rep", "a", "b"))
                for name, (score, x, n_a) in arrays.items():
                    sums = np.array([score[np.argsort((p * x + q) % PRIME, kind="stable")[:n_a]].sum() for p, q in zip(a, b, strict=True)], np.float64)
                    yield pa.record_batch([pa.array([name] * len(rep), pa.string()), pa.array(rep), pa.array(sums)], names=["metric", "rep", "s"])

        sums = reps.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "metric string, rep long, s double")
    else:
        sums = _selected(dealt, reps, counts)
    rest = (F.col("total") - F.col("s")) / (F.col("n") - F.col("n_a"))
    diffs = sums.join(F.broadcast(counts), "metric").withColumn("d", F.round(F.col("s") / F.col("n_a") - rest, 9))
    return diffs.groupBy("metric").agg(F.round(F.first("observed"), 6).alias("observed"), F.avg((F.abs("d") >= F.round(F.abs("observed"), 9)).cast("double")).alias("p_value"), F.expr("percentile(d, 0.025)").alias("ci_lo"), F.expr("percentile(d, 0.975)").alias("ci_hi"))


def _selected(dealt: DataFrame, reps: DataFrame, counts: DataFrame) -> DataFrame:
    """(metric, rep, s): the sum of the first n_a scores of every round, wherever the scores lie.

    Each round has an interval of keys that its n_a-th one lies in. A pass over the scores counts the keys in PARTS
    parts of every interval, added up within a task and over tasks, and the part that holds the n_a-th takes its place,
    until FEW scores or one key are left. The last pass adds the scores below the interval up and returns those within,
    which a window by round puts in order. A task holds counts of all rounds, and a driver the intervals: neither
    grows with the scores.
    """
    dealt = cut(dealt.sparkSession, dealt, "permutation")
    keys = reps.orderBy("rep").toPandas()
    a, b = keys["a"].to_numpy(np.int64), keys["b"].to_numpy(np.int64)
    n_a = {r["metric"]: r["n_a"] for r in counts.collect()}
    rounds = len(keys)
    low = {m: np.zeros(rounds, np.int64) for m in n_a}
    high = {m: np.full(rounds, PRIME, np.int64) for m in n_a}
    below = {m: np.zeros(rounds, np.int64) for m in n_a}
    inside = {m: np.full(rounds, np.iinfo(np.int64).max) for m in n_a}

    def each(batches):
        """(metric, rounds, keys of these rounds by score, positions of the scores in the batch) in pieces of HELD numbers."""
        for batch in batches:
            metric, x = np.array(batch.column("metric").to_pylist(), object), np.asarray(batch.column("x"), np.int64)
            for m in sorted(set(metric.tolist()) & set(n_a)):
                at = np.flatnonzero(metric == m)
                step = max(1, HELD // len(at))
                for k in range(0, rounds, step):
                    some = slice(k, k + step)
                    yield batch, m, some, (a[some, None] * x[at] + b[some, None]) % PRIME, at

    while any(((inside[m] > FEW) & (high[m] - low[m] > 1)).any() for m in n_a):
        lo, hi = dict(low), dict(high)

        def count(batches, lo=lo, hi=hi):
            total = {m: np.zeros((rounds, PARTS), np.int64) for m in n_a}
            for _, m, some, key, _ in each(batches):
                width = hi[m][some] - lo[m][some]
                part = (key - lo[m][some, None]) * PARTS // width[:, None]
                part = np.where((key >= lo[m][some, None]) & (key < hi[m][some, None]), part, PARTS)
                flat = part + (np.arange(len(part)) * (PARTS + 1))[:, None]
                total[m][some] += np.bincount(flat.ravel(), minlength=len(part) * (PARTS + 1)).reshape(len(part), PARTS + 1)[:, :PARTS]
            for m, t in total.items():
                i, j = np.nonzero(t)
                yield pa.record_batch([pa.array([m] * len(i), pa.string()), pa.array(i), pa.array(j), pa.array(t[i, j])], names=["metric", "rep", "part", "n"])

        found = dealt.mapInArrow(count, "metric string, rep long, part long, n long").groupBy("metric", "rep", "part").agg(F.sum("n").alias("n")).toArrow().to_pandas()
        for m, rows in found.groupby("metric"):
            table = np.zeros((rounds, PARTS), np.int64)
            table[rows["rep"], rows["part"]] = rows["n"]
            sums = below[m][:, None] + np.cumsum(table, axis=1)
            part = (sums < n_a[m]).sum(axis=1)
            here = np.arange(rounds)
            width = high[m] - low[m]
            inside[m] = table[here, part]
            below[m] = sums[here, part] - inside[m]
            # The keys of a part: those whose place times PARTS over the width is its number.
            low[m], high[m] = low[m] + -(-part * width // PARTS), low[m] + -(-(part + 1) * width // PARTS)

    def close(batches):
        total = {m: np.zeros(rounds) for m in n_a}
        for batch, m, some, key, at in each(batches):
            score = np.asarray(batch.column("score"))[at]
            total[m][some] += (key < low[m][some, None]) @ score
            i, j = np.nonzero((key >= low[m][some, None]) & (key < high[m][some, None]))
            if len(i):
                rows = batch.select(["arm", "pos", "score"]).take(pa.array(at[j]))
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(i), pa.string()), pa.array(i + some.start), pa.array(key[i, j]), *rows.columns], names=["metric", "rep", "key", "arm", "pos", "score"])
        for m, t in total.items():
            none = pa.nulls(rounds)
            kinds = [f.type for f in schema]
            yield pa.RecordBatch.from_arrays([pa.array([m] * rounds, pa.string()), pa.array(np.arange(rounds)), none.cast(pa.int64()), none.cast(kinds[0]), none.cast(kinds[1]), pa.array(t)], names=["metric", "rep", "key", "arm", "pos", "score"])

    schema = dealt.limit(0).select("arm", "pos").toArrow().schema
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    rows = dealt.mapInArrow(close, f"metric string, rep long, key long, arm {kinds['arm']}, pos {kinds['pos']}, score double")
    wanted = dealt.sparkSession.createDataFrame(pa.table({"metric": pa.array([m for m in n_a for _ in range(rounds)], pa.string()), "rep": pa.array(np.tile(np.arange(rounds), len(n_a))), "take": pa.array(np.concatenate([n_a[m] - below[m] for m in n_a]) if n_a else np.zeros(0, np.int64))}))
    order = W.partitionBy("metric", "rep").orderBy(F.col("key").asc_nulls_last(), "arm", "pos")
    ranked = rows.withColumn("k", F.row_number().over(order)).join(wanted, ["metric", "rep"])
    return ranked.where(F.col("key").isNull() | (F.col("k") <= F.col("take"))).groupBy("metric", "rep").agg(F.sum("score").alias("s"))


def paired_statistic(scores: DataFrame) -> DataFrame:
    """(metric, n, mean_diff, std_diff, statistic) of A - B over positions that both arms have, up to the shorter one's end."""
    pairs = scores.groupBy("metric", "pos").agg(F.max(F.when(F.col("arm") == "A", F.col("score"))).alias("a"), F.max(F.when(F.col("arm") == "B", F.col("score"))).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    d = F.col("a") - F.col("b")
    rows = pairs.groupBy("metric").agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std_diff"))
    return rows.withColumn("statistic", F.when(F.col("n") < 2, 0.0).when(F.col("std_diff") > 0, F.col("mean_diff") / (F.col("std_diff") / F.sqrt(F.col("n").cast("double")))).otherwise(_without_spread(F.col("mean_diff"))))


def paired(scores: DataFrame) -> DataFrame:
    """Paired t with p and the 95 % interval of the mean difference (n - 1 degrees)."""
    rows = paired_statistic(scores)
    half = t_975((F.col("n") - 1).cast("double")) * F.col("std_diff") / F.sqrt(F.col("n").cast("double"))
    small = F.col("n") < 2
    return rows.select("*", F.when(small, 1.0).otherwise(t_p("statistic", (F.col("n") - 1).cast("double"))).alias("p_value"), F.when(small, 0.0).otherwise(F.col("mean_diff") - half).alias("ci_lo"), F.when(small, 0.0).otherwise(F.col("mean_diff") + half).alias("ci_hi"))
