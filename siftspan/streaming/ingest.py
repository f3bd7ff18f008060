"""Streaming extensions: documents chunked as they arrive, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftspan.operators.chunkers import chunk


def documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def append_chunks(docs: DataFrame, out: str, checkpoint: str, strategy: str = "recursive", size: int = 512, overlap: int = 64, once: bool = False) -> StreamingQuery:
    """Chunks of arriving documents, appended to a Parquet folder; each file is read once across restarts."""
    stream = chunk(docs, strategy, size, overlap).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (stream.trigger(availableNow=True) if once else stream).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(window, event_type, n, total) of `events(ts, event_type, value)`; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
