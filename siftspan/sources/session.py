"""Session builder with the settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Rows and bytes of an Arrow batch at most: a worker holds a few times that, whatever the size of its partition.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def modest_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to `BATCHES` at most; smaller settings stay."""
    for name, most in BATCHES.items():
        now = int(spark.conf.get(name).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def session(app: str = "siftspan", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """AQE on, UTC, Arrow on. Shuffle partitions are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k: str(v) for k, v in BATCHES.items()} | {k.replace("__", "."): v for k, v in conf.items()}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
