"""The streaming extensions on files."""

from siftspan.streaming import ingest


def test_chunks_arrive_once(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 100), (2, "short")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        q = ingest.append_chunks(ingest.documents(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", "fixed", 100, 0, once=True)
        q.awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 6


def test_event_windows(spark, tmp_path):
    """Tumbling and sliding windows; an event that comes later than the watermark allows is left out."""
    schema = "ts timestamp, event_type string, value double"
    rows = [[("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:04:00", "a", 2.0), ("2024-01-01 00:06:00", "b", 4.0)], [("2024-01-01 01:00:00", "a", 8.0)], [("2024-01-01 00:02:00", "a", 99.0), ("2024-01-01 00:59:00", "a", 16.0)], [("2024-01-01 03:00:00", "z", 0.0)], [("2024-01-01 03:00:01", "z", 0.0)]]
    files = spark.createDataFrame([(k, *r) for k, part in enumerate(rows) for r in part], "file int, t string, event_type string, value double").selectExpr("file", "to_timestamp(t) AS ts", "event_type", "value")
    for size, slide, want in (("5 minutes", None, {("00:00", "a"): (2, 3.0), ("00:05", "b"): (1, 4.0), ("01:00", "a"): (1, 8.0), ("00:55", "a"): (1, 16.0)}), ("10 minutes", "5 minutes", {("00:00", "a"): (2, 3.0), ("00:00", "b"): (1, 4.0), ("00:05", "b"): (1, 4.0)})):
        where = f"{tmp_path}/{size[0]}"
        for k in range(len(rows)):
            files.where(f"file = {k}").drop("file").coalesce(1).write.mode("append").parquet(f"file://{where}/in")
            q = ingest.event_windows(spark.readStream.schema(schema).parquet(f"file://{where}/in"), "10 minutes", size, slide).selectExpr("window.start AS start", "event_type", "n", "total").writeStream.format("parquet").option("path", f"file://{where}/out").option("checkpointLocation", f"file://{where}/cp").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
        got = {(str(r["start"])[11:16], r["event_type"]): (r["n"], r["total"]) for r in spark.read.parquet(f"file://{where}/out").collect()}
        assert want.items() <= got.items() and all(t != 99.0 and t != 102.0 for _, t in got.values())
