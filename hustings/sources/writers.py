"""Sinks: tables, quarantine, partitioned bronze, raw documents and manifests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.config import DEFAULTS
from hustings.functions.text import path_token
from hustings.operators.quality import Split


def write_table(df: DataFrame, path: str) -> str:
    """Snappy Parquet, replacing what was there."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_split(parts: Split, path: str) -> list[str]:
    """The clean table, and the rejected one beside it if it has rows; a rejected one of an earlier run goes."""
    out = [write_table(parts.clean, path)]
    rejected = f"{path.rstrip('/')}_rejected"
    remove(parts.clean.sparkSession, rejected)
    if not parts.rejected.isEmpty():
        out.append(write_table(parts.rejected, rejected))
    return out


def save_as(df: DataFrame, name: str) -> int:
    """A catalog table, replaced; its number of rows as read back."""
    spark = df.sparkSession
    if "." in name:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name.rsplit('.', 1)[0]}")
    df.write.mode("overwrite").saveAsTable(name)
    return spark.table(name).count()


LEAF = ("window_start", "window_end", "provider", "leader_id")


def write_bronze(df: DataFrame, root: str) -> str:
    """Rows below window_start=/window_end=/provider=/leader_id=; the files hold these columns too, as ``_own_`` ones."""
    # one task writes a leaf's rows together; a large leaf is split by AQE's rebalance
    out = df.withColumns({f"_own_{c}": F.col(c) for c in LEAF}).hint("rebalance", *LEAF)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LEAF).parquet(root)
    return root


def read_bronze(spark: SparkSession, root: str) -> DataFrame:
    """The rows with their columns; filters on those of the folders read only these."""
    kept = spark.read.option("recursiveFileLookup", "true").parquet(root).schema
    own = [c for c in kept.names if not c.startswith("_own_")]
    types = ", ".join(f"`{c}` {kept[c if c in own else f'_own_{c}'].dataType.simpleString()}" for c in [*own, *LEAF])
    # with types of their own, codes in folder names keep their leading zeros
    df = spark.read.schema(types).parquet(root)
    return df.select(*LEAF, *own)


def scope_segment(name: Column, value: Column) -> Column:
    """scope=<name8>_<value12>_<hash8>, or scope=shared without a value."""
    own = F.concat(F.lit("scope="), path_token(name, 8), F.lit("_"), path_token(value, 12), F.lit("_"), F.substring(F.md5(value), 1, 8))
    return F.when(F.coalesce(value, F.lit("")) == "", "scope=shared").otherwise(own)


def window_segment(start: Column, end: Column) -> Column:
    return F.concat(F.lit("window="), F.date_format(start, "yyyyMMdd"), F.lit("_"), F.date_format(end, "yyyyMMdd"))


def raw_file_name(key: Column, content_type: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.md5(key), 1, 16), F.lit("."), F.when(content_type == "xml", "xml").otherwise("json"))


def check_path_budget(paths: Iterable[str], most: int = DEFAULTS.filesystem_path_budget) -> None:
    """Fails before anything is written if a path is too long."""
    for p in paths:
        if len(p) > most:
            raise ValueError(f"path of {len(p)} characters is over the budget of {most}: {p}")


def raw_documents(raw: DataFrame, root: str, provider: str, start: Column, end: Column, content_type: str = "json", most: int = DEFAULTS.filesystem_path_budget) -> DataFrame:
    """raw with the path, hash and JSON wrapper of each document; a path over the budget fails the query."""
    value = F.col("leader_id") if "leader_id" in raw.columns else F.lit("")
    path = F.concat_ws("/", F.lit(root), F.lit(f"provider={provider}"), window_segment(start, end), scope_segment(F.lit("leader_id"), value), raw_file_name(F.col("raw_document_key"), F.lit(content_type)))
    wrapper = F.to_json(F.struct("raw_document_key", "source_url", "row_count", F.col("payload")))
    checked = F.when(F.length(path) > most, F.raise_error(F.concat(F.lit(f"path over the budget of {most}: "), path)).cast("string")).otherwise(path)
    return raw.withColumns({"path": checked, "content": wrapper, "source_hash": F.md5(wrapper)})


def write_raw(documents: DataFrame) -> list[str]:
    """One file for each document, through Spark's own file system; returns the paths.

    A run has some documents for each of a few dozen cases; they are streamed through the driver one by one.
    """
    spark = documents.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for row in documents.select("path", "content").orderBy("path").toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(row["path"])
        stream = p.getFileSystem(conf).create(p, True)
        try:
            stream.write(bytearray(row["content"].encode()))
        finally:
            stream.close()
        out.append(row["path"])
    return out


def write_text(spark: SparkSession, path: str, text: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return path


def distinct_in_order(paths: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(paths))
