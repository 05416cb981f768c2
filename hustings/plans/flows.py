"""Flows: cohort, discovery, benchmark, backfill and the daily run. Transports and clocks are handed in."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.config import DEFAULTS, Settings
from hustings.operators import benchmark as bench
from hustings.operators.dims import commune_dim, leader_dim
from hustings.operators.news import HIT_SEQ, articles, bronze_hits, discoveries, query_audit, run_totals
from hustings.operators.sampling import build_sample, manifest
from hustings.operators.windows import daily_window, provider_window, resolve_window
from hustings.plans.lineage import Lineage
from hustings.sources.files import exists, file_md5, read_cases, read_csv, read_workbook, with_provenance
from hustings.sources.http import Transport
from hustings.sources.providers import Found, article_reader, curated, curated_bundle, event_index, outlets, provider, search_api
from hustings.sources.writers import distinct_in_order, raw_documents, write_bronze, write_raw, write_split, write_table, write_text


@dataclass(frozen=True)
class Source:
    """A raw file: key, URL, path, reader and separator."""

    key: str
    url: str
    path: str
    kind: str = "csv"
    sep: str = ";"
    required: bool = True


@dataclass(frozen=True)
class Run:
    run_id: str
    status: str
    error_count: int
    rows: int
    artifact_paths: tuple[str, ...]
    metrics: dict | None = None


def ingest(spark: SparkSession, source: Source, to: str, lineage: Lineage | None = None, md5: str = "", now: datetime | None = None) -> DataFrame:
    """A raw file to its bronze table, with provenance, and a snapshot in the lineage; the file's MD5 unless one is given."""
    if exists(spark, source.path):
        md5 = md5 or file_md5(spark, source.path).agg(F.min("md5")).first()[0] or ""
    df = read_workbook(spark, source.path) if source.kind == "xlsx" else read_csv(spark, source.path, source.sep)
    df = with_provenance(df, source.url, md5, now)
    write_table(df, to)
    out = spark.read.parquet(to)
    if lineage:
        lineage.log_snapshot(source.key, source.url, md5, to, out.count(), now)
    return out


def _logged(lineage: Lineage | None, flow: str, body: Callable[[str], Run], now: Callable[[], datetime]) -> Run:
    """Runs the body and logs it whatever happens; an error is logged as failed and raised again."""
    run_id, start = uuid.uuid4().hex, now()
    run = Run(run_id, "failed", 1, 0, ())
    try:
        run = body(run_id)
        return run
    finally:
        if lineage:
            lineage.log_run(run_id, flow, start, now(), run.status, run.rows, run.error_count, run.artifact_paths)


def _utc() -> datetime:
    return datetime.now(UTC)


def sampling_flow(spark: SparkSession, sources: dict[str, Source], out: str, s: Settings = DEFAULTS, lineage: Lineage | None = None, now: Callable[[], datetime] = _utc) -> Run:
    """Bronze, silver and the cohort. sources: geography, seats, candidates, incumbents, and tour2, which may fail:
    the run is partial then."""

    def body(run_id: str) -> Run:
        rows, errors, paths, got = 0, 0, [], {}
        for name in ("geography", "seats", "candidates", "incumbents", "tour2"):
            if name not in sources:
                continue
            try:
                got[name] = ingest(spark, sources[name], f"{out}/bronze/{name}", lineage, now=now())
            except (OSError, ValueError):
                if name != "tour2":
                    raise
                errors += 1
                continue
            rows += got[name].count()
            paths.append(f"{out}/bronze/{name}")
        communes = commune_dim(got["geography"], got["seats"], s)
        paths += write_split(communes, f"{out}/silver/dim_commune")
        dim = spark.read.parquet(f"{out}/silver/dim_commune")
        leaders = leader_dim(got["candidates"], dim, got.get("incumbents"), got.get("tour2"), s)
        paths += write_split(leaders, f"{out}/silver/dim_candidate_leader")
        people = spark.read.parquet(f"{out}/silver/dim_candidate_leader")
        sample, _ = build_sample(people, dim, s)
        paths.append(write_table(sample, f"{out}/gold/sample_leaders"))
        sample = spark.read.parquet(f"{out}/gold/sample_leaders")
        paths.append(write_text(spark, f"{out}/gold/sample_manifest.json", manifest(sample, dim, run_id, now().isoformat(), s.sampling_random_seed)))
        rows += dim.count() + people.count() + sample.count()
        return Run(run_id, "partial" if errors else "success", errors, rows, tuple(distinct_in_order(paths)))

    return _logged(lineage, "sampling_pipeline", body, now)


def discover(spark: SparkSession, cases: DataFrame, window: tuple[date, date], order: tuple[str, ...], transport: Transport, s: Settings = DEFAULTS, sleep: Callable[[float], None] = time.sleep) -> dict[str, Found]:
    """Every provider's findings. The outlets' documents are fetched once for the window, for all cases."""
    found = {}
    for name in order:
        start, end = provider_window(provider(name), *window)
        own = cases.withColumns({"window_start": F.lit(start), "window_end": F.lit(end)})
        if name == "curated":
            bundle = curated_bundle(spark, outlets(spark), (start, end), transport, s, sleep)
            found[name] = curated(own, bundle, article_reader(transport, s, sleep), s, end.isoformat())
        elif name == "gdelt":
            found[name] = event_index(own, transport, s, sleep)
        else:
            found[name] = search_api(own, transport, s, sleep)
    return found


def all_hits(found: dict[str, Found]) -> DataFrame:
    """Hits of all providers in their order: provider, case, place."""
    out = None
    for i, f in enumerate(found.values()):
        part = f.hits.withColumn(HIT_SEQ, F.struct(F.lit(i).alias("provider"), F.col("leader_id"), F.col(HIT_SEQ).alias("place")))
        out = part if out is None else out.unionByName(part)
    return out


def news_flow(spark: SparkSession, manifest_path: str, out: str, transport: Transport, start: date | None = None, end: date | None = None, order: tuple[str, ...] | None = None, s: Settings = DEFAULTS, lineage: Lineage | None = None, window_start: date | None = None, window_end: date | None = None, sleep: Callable[[float], None] = time.sleep, now: Callable[[], datetime] = _utc, flow: str = "news_ingest") -> Run:
    """Discovery for the sample's cases: raw documents, bronze hits and the audit. A failing provider makes the run
    partial; what was found is kept."""

    def body(run_id: str) -> Run:
        window = resolve_window(start, end, window_start, window_end)
        cases = read_cases(spark, manifest_path, window).cache()
        paths, hits, queries, errors = [], 0, 0, 0
        for name, f in discover(spark, cases, window, order or s.news_provider_order, transport, s, sleep).items():
            bounds = (F.lit(window[0]), F.lit(window[1]))
            if "raw_document_key" in f.raw.columns:
                docs = raw_documents(f.raw, f"{out}/raw/news", name, *bounds, most=s.filesystem_path_budget).cache()
                paths += write_raw(docs)
                stored = docs.select("raw_document_key", "path", "source_url", "source_hash").dropDuplicates(["raw_document_key"])
            else:
                stored = spark.createDataFrame([], "raw_document_key string, path string, source_url string, source_hash string")
            audit = query_audit(f.audits)
            rows = bronze_hits(f.hits.withColumns({"window_start": bounds[0], "window_end": bounds[1]}), stored)
            paths += [write_bronze(rows, f"{out}/bronze/news_hits"), write_bronze(audit, f"{out}/bronze/query_audit")]
            total = run_totals(audit).first()
            hits, queries, errors = hits + total["hit_count"], queries + total["query_count"], errors + total["error_count"]
        return Run(run_id, "partial" if errors else "success", errors, hits, tuple(distinct_in_order(paths)), {"query_count": queries, "hit_count": hits})

    return _logged(lineage, flow, body, now)


def backfill_flow(spark: SparkSession, manifest_path: str, out: str, transport: Transport, **more) -> Run:
    """The slow provider alone, over the analysis window."""
    return news_flow(spark, manifest_path, out, transport, order=("gdelt",), flow="gdelt_backfill", **more)


def daily_flow(spark: SparkSession, manifest_path: str, out: str, transport: Transport, day: date | None = None, order: tuple[str, ...] | None = None, **more) -> Run:
    """The day and the next; days overlap, and canonical URLs tell repeats apart."""
    first, last = daily_window(day)
    return news_flow(spark, manifest_path, out, transport, window_start=first, window_end=last, order=order, flow="daily_news", **more)


def benchmark_flow(spark: SparkSession, cases: DataFrame, truth: DataFrame, out: str, transport: Transport, order: tuple[str, ...] | None = None, s: Settings = DEFAULTS, lineage: Lineage | None = None, sleep: Callable[[float], None] = time.sleep, now: Callable[[], datetime] = _utc) -> Run:
    """Discovery against the truth cases: five tables and the metrics."""
    from hustings.operators.news import fetch_status

    def body(run_id: str) -> Run:
        first = cases.agg(F.min("window_start"), F.max("window_end")).first()
        found = discover(spark, cases, (first[0], first[1]), order or s.news_benchmark_provider_order, transport, s, sleep)
        hits = all_hits(found).cache()
        audit = None
        for f in found.values():
            a = query_audit(f.audits)
            audit = a if audit is None else audit.unionByName(a)
        found_rows = discoveries(hits).cache()
        got = article_reader(transport, s, sleep)(found_rows.select(F.col("canonical_url").alias("url")).distinct())
        status = fetch_status(F.col("error_type") != "", F.lit(True), F.col("text"), s.dq_min_article_text_length)
        fetched = got.select(F.col("url").alias("canonical_url"), status.alias("fetch_status"), F.when(status == "success", F.col("text")).otherwise("").alias("body_text")).cache()
        result = bench.results(found_rows, truth, audit, fetched).cache()
        tables = {"fact_article": articles(hits, fetched, s.keep_body_text), "fact_article_discovery": found_rows, "benchmark_results": result, "provider_queries": audit}
        diagnostics = [f.diagnostics for f in found.values() if f.diagnostics is not None]
        if diagnostics:
            tables["outlet_diagnostics"] = diagnostics[0]
        paths = [write_table(t, f"{out}/{n}") for n, t in tables.items()]
        metrics = bench.summary(result, truth, audit, fetched, hits).first().asDict()
        paths.append(write_text(spark, f"{out}/benchmark_summary.json", json.dumps({"run_id": run_id, **metrics}, default=str, indent=2)))
        errors = run_totals(audit).first()["error_count"]
        return Run(run_id, "partial" if errors else "success", errors, result.count(), tuple(paths), metrics)

    return _logged(lineage, "news_benchmark", body, now)
