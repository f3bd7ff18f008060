"""Search over configurations: many parameter sets in one plan, samplers on the driver, trials as a table."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterator
from itertools import islice, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.operators import bm25
from siftspan.operators.topk import topk

#: What a search over pipelines chooses from, and the ranges of numbers that only some strategies have.
SPACE = {"chunker": ("fixed", "recursive", "document_aware"), "chunk_size": (128, 256, 512, 1024), "chunk_overlap": (0, 32, 64, 128), "top_k": tuple(range(3, 21)), "strategy": ("dense", "bm25", "hybrid")}
RANGES = {"bm25": {"k1": (0.5, 3.0), "b": (0.0, 1.0)}, "hybrid": {"dense_weight": (0.1, 0.9)}}


def bm25_grid(spark: SparkSession, docs: DataFrame, queries: DataFrame, grid: list[tuple[int, float, float]], k: int = 10) -> DataFrame:
    """(trial, query_id, doc_id, score, rank) for all (trial, k1, b) at once: documents are read and counted once, and
    only the weights of their terms differ. Scores are raw sums."""
    numbers = F.array(*[F.lit(trial) for trial, *_ in grid])
    raw = bm25.scores(docs, queries, k, [(k1, b) for _, k1, b in grid], normalised=False).withColumn("trial", F.get(numbers, F.col("trial")))
    return topk(raw.withColumn("key", F.struct("trial", "query_id")), k, query="key").select("trial", "query_id", "doc_id", "score", "rank")


def best(trials: DataFrame, maximise: bool = True) -> DataFrame:
    """One row: the best complete trial of (number, value, ...); equal values: the smaller number."""
    order = F.col("value").desc() if maximise else F.col("value").asc()
    return trials.where(F.col("value").isNotNull()).orderBy(order, "number").limit(1)


def grid(space: dict[str, tuple]) -> Iterator[dict]:
    for values in product(*space.values()):
        yield dict(zip(space, values, strict=True))


def finished(params: dict, number: Callable[[str, float, float], float]) -> dict:
    """Choices with an overlap of half the size at most, and the numbers that their strategy has."""
    out = dict(params)
    if "chunk_overlap" in out and "chunk_size" in out:
        out["chunk_overlap"] = min(out["chunk_overlap"], out["chunk_size"] // 2)
    for name, (low, high) in RANGES.get(out.get("strategy"), {}).items():
        out[name] = number(name, low, high)
    return out


def random_search(space: dict[str, tuple], n: int, seed: int = 42) -> Iterator[dict]:
    draw = random.Random(seed)
    for _ in range(n):
        yield finished({k: draw.choice(v) for k, v in space.items()}, lambda _, low, high: draw.uniform(low, high))


class Parzen:
    """A tree-structured Parzen sampler: after `start` random trials, of `tries` draws from what the better trials
    chose, the one whose odds against what the others chose are best. Each parameter is looked at by itself."""

    def __init__(self, space: dict[str, tuple], seed: int = 42, start: int = 10, tries: int = 24, maximise: bool = True):
        self.space, self.draw, self.start, self.tries, self.maximise = space, random.Random(seed), start, tries, maximise

    def propose(self, trials: list[tuple[dict, float | None]]) -> dict:
        """The next parameters after `trials` (parameters, value; None: pruned)."""
        known = sorted(((v, k) for k, (_, v) in enumerate(trials) if v is not None), key=lambda x: (-x[0] if self.maximise else x[0], x[1]))
        if len(known) < self.start:
            return finished({k: self.draw.choice(v) for k, v in self.space.items()}, lambda _, low, high: self.draw.uniform(low, high))
        n = min(25, math.ceil(0.1 * len(known)) + 1)
        better, worse = ([trials[k][0] for _, k in part] for part in (known[:n], known[n:]))

        def choice(name: str, options: tuple):
            count = lambda rows: {o: 1 + sum(r.get(name) == o for r in rows) for o in options}
            good, bad = count(better), count(worse)
            drawn = self.draw.choices(options, [good[o] for o in options], k=self.tries)
            return max(drawn, key=lambda o: good[o] / sum(good.values()) / (bad[o] / sum(bad.values())))

        def number(name: str, low: float, high: float) -> float:
            good, bad = ([r[name] for r in rows if name in r] for rows in (better, worse))
            width = lambda xs: (high - low) / (1 + len(xs)) ** 0.5 / 2

            def density(x: float, xs: list[float]) -> float:
                w = width(xs)
                return (1 / (high - low) + sum(math.exp(-(((x - c) / w) ** 2) / 2) / w / 2.5066 for c in xs)) / (1 + len(xs))

            def one() -> float:
                k = self.draw.randrange(len(good) + 1)
                return self.draw.uniform(low, high) if k == len(good) else min(high, max(low, self.draw.gauss(good[k], width(good))))

            return max((one() for _ in range(self.tries)), key=lambda x: density(x, good) / density(x, bad))

        return finished({k: choice(k, v) for k, v in self.space.items()}, number)


TRIAL = "number int, params map<string,string>, value double, state string"


def optimise(spark: SparkSession, objective: Callable[[dict], float], params: Iterator[dict] | Parzen, path: str | None = None, n_trials: int | None = None, timeout: float | None = None) -> DataFrame:
    """(number, params, value, state) of all trials; a trial that raises is pruned, with the error among its parameters.

    `params` is what to try, or a sampler that proposes from the trials so far. With a path, trials are kept there as
    they end, and those that are there already come first: they are read, not run again. No trial begins after
    `timeout` seconds, or when there are `n_trials`.
    """
    began = time.monotonic()
    rows: list[tuple] = []
    if path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            rows = sorted(tuple(r) for r in spark.read.schema(TRIAL).parquet(path).collect())
    done = len(rows)
    tried = [({k: _read(v) for k, v in p.items()}, value) for _, p, value, _ in rows]
    source = None if isinstance(params, Parzen) else islice(params, done, None)
    if source is None and n_trials is None:
        raise ValueError("a sampler needs a number of trials")
    while (n_trials is None or len(rows) < n_trials) and (timeout is None or time.monotonic() - began < timeout):
        p = params.propose(tried) if source is None else next(source, None)
        if p is None:
            break
        said, value, state = {k: str(v) for k, v in p.items()}, None, "complete"
        try:
            value = float(objective(p))
        except Exception as e:  # whatever a configuration makes fail, the study goes on
            said, state = said | {"error": str(e)[:200]}, "pruned"
        rows.append((len(rows), said, value, state))
        tried.append((p, value))
        if path:
            spark.createDataFrame(rows[-1:], TRIAL).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame(rows, TRIAL)


def _read(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def pipeline_objective(spark: SparkSession, docs: DataFrame, queries: DataFrame, metric: str = "answer_relevance") -> Callable[[dict], float]:
    """The mean of a metric over `queries(query_id, query, ground_truth?)` of a pipeline of given parameters over `docs`."""
    from siftspan.plans.pipeline import Config, Pipeline

    def run(params: dict) -> float:
        names = {"chunker", "chunk_size", "chunk_overlap", "strategy", "top_k", "k1", "b", "dense_weight"}
        pipeline = Pipeline(spark, Config(**{k: v for k, v in params.items() if k in names}))
        pipeline.ingest(docs)
        return pipeline.evaluate(queries, (metric,)).agg(F.avg("score").alias("x")).first()["x"] or 0.0

    return run
