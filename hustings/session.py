"""SparkSession factory with the settings every flow relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results (time zone, ANSI) or that large plans need (AQE).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "hustings", **extra: str) -> SparkSession:
    """Get or create a session; ``master`` and ``shuffle_partitions`` are left to the cluster when None."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
