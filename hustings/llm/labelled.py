"""Labelled rows to learn from, and the split that keeps rows out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text leaves the remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_rows(labels: DataFrame, column: str, modulus: int, remainder: int, most: int | None = None) -> DataFrame:
    """doc_id and label (0 or 1) of the rows outside the held-out ones, ids with contradicting labels left out; with
    ``most`` of at most so many, the same for the same table: those first by a hash of doc_id."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    ids = ids.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(modulus, remainder))
    once = ids.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    return once if most is None else once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
