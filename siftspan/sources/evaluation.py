"""Evaluation files and result tables: what a report shows of strategies, metrics, comparisons, trials and frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspan.operators import metrics, pareto

SAMPLES = "sample_id string, query string, answer string, contexts array<string>, ground_truth string, latency_seconds double"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples of a JSON file (an array of objects, or an object a line): missing fields are null.

    Samples without an id get a number by their place in the order of query and answer.
    """
    rows = spark.read.schema(SAMPLES).option("multiLine", True).json(path)
    number = F.xxhash64("query", "answer", F.to_json("contexts"))
    return rows.withColumn("sample_id", F.coalesce("sample_id", F.format_string("%016x", number))).withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def strategy_table(evaluated: dict[str, DataFrame]) -> DataFrame:
    """(strategy, metric, mean_score, n), long, of `metrics.evaluate` rows by name of a strategy."""
    parts = [metrics.means(rows).withColumn("strategy", F.lit(name)) for name, rows in evaluated.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("strategy", "metric", "mean_score", "n")


def radar_table(means: DataFrame) -> DataFrame:
    """A row a metric and a column a strategy of `strategy_table`."""
    return means.groupBy("metric").pivot("strategy").agg(F.first("mean_score"))


def frontier_by(points: DataFrame, objectives: list[str], minimise: tuple[str, ...], by: str) -> DataFrame:
    """The frontier as the line that a plot draws: optimal points in order of one objective (`place` from 1)."""
    from pyspark.sql import Window as W

    return pareto.optimal(points, objectives, minimise).withColumn("place", F.row_number().over(W.orderBy(by, "point_id")))


def invented(spark: SparkSession, vocabulary: list[str], rows: int, shortest: int, longest: int, seed: int = 0) -> DataFrame:
    """(doc_id, text): texts of `shortest` to `longest` words of the caller's vocabulary, each place drawn by a hash of
    seed, row and place: expressions alone, so tasks make them where they are read."""
    if not vocabulary or not 1 <= shortest <= longest:
        raise ValueError("a vocabulary and lengths of 1 or more are needed")
    words = F.array(*map(F.lit, vocabulary))
    length = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(longest - shortest + 1)) + shortest).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(1), length), lambda j: F.get(words, F.pmod(F.xxhash64(F.lit(seed), "id", j), F.lit(len(vocabulary))).cast("int"))), " ")
    return spark.range(rows).select(F.col("id").alias("doc_id"), text.alias("text"))


def excerpts(docs: DataFrame, rows: int, words: int, seed: int = 0) -> DataFrame:
    """(query_id, query): as many queries, each some neighbouring words of another document of `docs(doc_id, text)`, with
    its id; the documents are the first by a hash, those without words are left out."""
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    chosen = docs.select(F.col("doc_id").alias("query_id"), w.alias("w"), F.xxhash64(F.lit(seed), "doc_id").alias("h")).where(F.size("w") > 0).orderBy("h", "query_id").limit(rows)
    start = F.pmod("h", F.greatest(F.size("w") - words + 1, F.lit(1))).cast("int") + 1
    return chosen.select("query_id", F.array_join(F.slice("w", start, words), " ").alias("query"))


def table_definition(name: str, dimension: int, metric: str = "cosine", index: str = "hnsw", lists: int = 100, m: int = 16, ef: int = 64) -> list[str]:
    """Statements for a database with vectors that make a table and its index; names are checked, as they are not quoted.

    For a table that is written by JDBC: nothing here connects to one.
    """
    if not name.isidentifier() or dimension < 1 or metric not in OPERATORS:
        raise ValueError("a table needs a plain name, a dimension and a known metric")
    out = ["CREATE EXTENSION IF NOT EXISTS vector", f"CREATE TABLE IF NOT EXISTS {name} (id TEXT PRIMARY KEY, embedding vector({int(dimension)}), metadata JSONB DEFAULT '{{}}'::jsonb)"]
    options = {"ivfflat": f"lists = {int(lists)}", "hnsw": f"m = {int(m)}, ef_construction = {int(ef)}"}
    if index:
        out.append(f"CREATE INDEX IF NOT EXISTS {name}_embedding_idx ON {name} USING {index} (embedding {OPERATORS[metric][0]}) WITH ({options[index]})")
    return out


#: Operator classes and distance operators of the metrics.
OPERATORS = {"cosine": ("vector_cosine_ops", "<=>"), "l2": ("vector_l2_ops", "<->"), "dot": ("vector_ip_ops", "<#>")}
