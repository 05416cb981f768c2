"""File sources: all-text CSV with an encoding fallback, workbooks, Parquet, manifests and file hashes."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import UTC, date, datetime
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hustings.operators.contracts import CANDIDATE_CASE, TRUTH_CASE, schema
from hustings.operators.dims import SEQ


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def head_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def file_md5(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5) of each file below a path; the content never leaves the executors."""
    return head_bytes(spark, path).select("path", "length", F.md5("content").alias("md5"))


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether the files decode as UTF-8, tested where they are read, on the bytes of their lines."""
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("raw"))
    return lines.filter(~F.call_function("is_valid_utf8", F.col("raw").cast("string"))).limit(1).isEmpty()


def read_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str | None = None) -> DataFrame:
    """All columns as text, codes with their leading zeros; UTF-8, or Latin-1 where that fails.

    A missing file is FileNotFoundError, one without rows ValueError. Rows are numbered in ``_row_seq`` by file
    order (Spark's scan order within a file).
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    encoding = encoding or ("UTF-8" if is_utf8(spark, path) else "ISO-8859-1")
    df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("quote", '"').option("escape", '"').option("multiLine", True).option("inferSchema", False).csv(path)
    if not df.columns or df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df.withColumn(SEQ, F.monotonically_increasing_id())


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """Cells of a workbook's sheet as text, row by row, from its XML parts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)
        chosen = sheets[sheet] if isinstance(sheet, int) else next((s for s in sheets if s.get("name") == sheet), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet!r}")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[chosen.get(f"{{{_NS['r']}}}id")].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        for row in ElementTree.fromstring(z.read(part)).findall("m:sheetData/m:row", _NS):
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", _NS):
                column = 0
                for letter in re.match("[A-Z]+", c.get("r", "A"))[0]:
                    column = 26 * column + ord(letter) - 64
                value = c.find("m:v", _NS)
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif value is None:
                    text = None
                else:
                    text = shared[int(value.text)] if c.get("t") == "s" else value.text
                cells[column - 1] = text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet's rows as text. Reader errors are ValueError, a missing file is FileNotFoundError.

    Workbooks hold a million rows at most, so one is read whole, through Spark's own file access, by one task.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    try:
        content = head_bytes(spark, path).select("content").first()[0]
        header, *rows = sheet_rows(bytes(content), sheet)
    except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
        raise ValueError(f"can't read {path}: {e}") from e
    names = [h for h in header if h]
    if not rows:
        raise ValueError(f"no rows in {path}")
    shaped = [(*(r + [None] * len(names))[: len(names)], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(shaped, T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(SEQ, T.LongType())]))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table; no column is read."""
    return spark.read.parquet(path).count()


def read_cases(spark: SparkSession, path: str, window: tuple[date, date]) -> DataFrame:
    """Candidate cases from a sample manifest (JSON), with one search window for all."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("candidates").alias("c")).select("c.*")
    keep = [F.col(c).cast("string").alias(c) for c in ("leader_id", "full_name", "commune_name", "dep_code", "city_size_bucket")]
    return rows.select(*keep, F.lit(window[0]).alias("window_start"), F.lit(window[1]).alias("window_end"))


def read_benchmark_manifest(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """(cases, truth cases, outlets) of a benchmark manifest in YAML or JSON. Outlets are read and not applied."""
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = json.loads(text)
    day = lambda x: x if isinstance(x, date) or x is None else date.fromisoformat(str(x))
    window = data["benchmark_window"]
    start, end = (day(window[next(k for k in window if part in k)]) for part in ("start", "end"))
    cases = [(*(str(c[k]) for k in ("leader_id", "full_name", "commune_name", "dep_code", "city_size_bucket")), start, end) for c in data["candidates"]]
    truth = [(t["benchmark_case_id"], str(t["leader_id"]), t["expected_outlet_key"], t.get("manual_article_url"), t.get("manual_title"), day(t.get("manual_published_at"))) for t in data["manual_truth_articles"]]
    return spark.createDataFrame(cases, schema(CANDIDATE_CASE)), spark.createDataFrame(truth, schema(TRUTH_CASE)), tuple(data.get("curated_outlets") or ())


def with_provenance(df: DataFrame, url: str, md5: str, now: datetime | None = None) -> DataFrame:
    stamp = (now or datetime.now(UTC)).isoformat()
    return df.withColumns({"_source_url": F.lit(url), "_ingested_at": F.lit(stamp), "_source_hash": F.lit(md5)})


def csv_header(text: str, sep: str = ";") -> list[str]:
    return next(csv.reader(io.StringIO(text), delimiter=sep))
