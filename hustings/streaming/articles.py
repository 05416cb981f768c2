"""Discovery as a stream: hits arrive as files, repeats of an article within the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.functions.url import canonical_url
from hustings.operators.contracts import SEARCH_HIT, schema


def hit_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schema(SEARCH_HIT)).parquet(path)


def first_seen(hits: DataFrame, late: str = "2 days", ts: str = "published_at", url: str = "article_url") -> DataFrame:
    """The first hit of each canonical URL; state is kept for as long as overlapping daily windows can repeat one."""
    return hits.withColumn("canonical_url", canonical_url(url)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["canonical_url"])


def counts_by_window(hits: DataFrame, width: str = "7 days", late: str = "2 days", ts: str = "published_at", by: str = "provider") -> DataFrame:
    """Hits of each tumbling window, written once the watermark has passed it."""
    rows = hits.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def run_once(stream: DataFrame, to: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, and stop; the checkpoint makes the next call go on from here."""
    query = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
