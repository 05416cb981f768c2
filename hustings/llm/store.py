"""Scratch tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost executor costs a
re-read and never a recomputation of the whole plan. Folders are removed at interpreter exit.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


_shipped: set[str] = set()
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, from which Python workers import the operators' functions."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES, None) is None:
        # rows hold texts, so a batch is bounded by its bytes, unless the session says otherwise
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    if sc.applicationId in _shipped:
        return
    root, d = Path(__file__).resolve().parents[1], tempfile.mkdtemp(prefix="hustings-")
    with zipfile.ZipFile(f"{d}/{root.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    # the driver serves this file as long as it runs
    sc.addPyFile(z.filename)
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="hustings-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return _own[sc.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def made(spark: SparkSession) -> list[str]:
    """Scratch folders that the session has by now."""
    return [path for s, path in _made if s is spark]


def materialise(df: DataFrame, name: str, passing: list[str] | None = None) -> DataFrame:
    """Write once to the shared folder and read back with the same schema; ``passing`` gets the folder of a table
    that its caller will release."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if passing is not None:
        passing.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """How many ways keyed work is dealt; follows the session, which is sized for the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release(paths: list[str | None] | None = None) -> None:
    """Delete scratch folders, which nothing may read any more; all of them by default."""
    for spark, path in list(_made):
        if paths is None or path in paths:
            try:
                jvm = spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # noqa: BLE001 - the session may be gone at exit
                pass
            _made.remove((spark, path))


atexit.register(release)


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty: no other column can clash with an operator's own."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
