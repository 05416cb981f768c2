"""Lineage: source snapshots and runs, as small tables that are replaced as a whole."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.operators.contracts import META_RUN, META_SNAPSHOT, conform, empty, schema
from hustings.sources.files import exists

STATUSES = ("success", "partial", "failed")


def insert_if_absent(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """existing with the rows of new whose key it lacks."""
    return existing.unionByName(new.join(existing.select(*key), list(key), "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """new, and the rows of existing whose key it lacks."""
    return existing.join(new.select(*key), list(key), "left_anti").unionByName(new)


def latest_hash(snapshots: DataFrame, source: str) -> str | None:
    """Hash of a source's newest snapshot; None without one."""
    return snapshots.filter(F.col("source_key") == source).agg(F.max_by("source_hash", "fetched_at")).first()[0]


class Lineage:
    """The two meta tables below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, ddl: str) -> DataFrame:
        # versions: the newest complete folder is the table, so a failed write loses nothing
        at = self._version(name)
        return conform(self.spark.read.parquet(f"{self.root}/{name}/v{at}"), ddl) if at else empty(self.spark, ddl)

    def _version(self, name: str) -> int:
        n = 0
        while exists(self.spark, f"{self.root}/{name}/v{n + 1}/_SUCCESS"):
            n += 1
        return n

    def _write(self, name: str, df: DataFrame) -> None:
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}/v{self._version(name) + 1}")

    @property
    def snapshots(self) -> DataFrame:
        return self._read("meta_source_snapshot", META_SNAPSHOT)

    @property
    def runs(self) -> DataFrame:
        return self._read("meta_run", META_RUN)

    def log_snapshot(self, source: str, url: str, md5: str, path: str, rows: int, now: datetime | None = None) -> str:
        now = now or datetime.now(UTC)
        key = hashlib.md5(f"{source}:{now.isoformat()}".encode()).hexdigest()
        row = self.spark.createDataFrame([(key, source, url, md5, path, rows, now)], schema(META_SNAPSHOT))
        self._write("meta_source_snapshot", insert_if_absent(self.snapshots, row, ["snapshot_id"]))
        return key

    def log_run(self, run_id: str, flow: str, start: datetime, end: datetime, status: str, rows: int, errors: int, paths: Sequence[str]) -> None:
        if status not in STATUSES:
            raise ValueError(f"unknown status {status!r}")
        row = self.spark.createDataFrame([(run_id, flow, start, end, status, rows, errors, json.dumps(list(paths)))], schema(META_RUN))
        self._write("meta_run", upsert(self.runs, row, ["run_id"]))
