"""Search hits to articles, discoveries, audits and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.config import DEFAULTS
from hustings.functions.dates import iso_utc, partition_date
from hustings.functions.keys import article_key, discovery_key
from hustings.functions.text import strip
from hustings.functions.url import canonical_url, sanitized_url
from hustings.operators.contracts import BRONZE_HITS, DISCOVERY, FACT_ARTICLE, QUERY_AUDIT, conform

HIT_SEQ = "hit_seq"


def canonical_hits(hits: DataFrame) -> DataFrame:
    return hits.withColumn("canonical_url", canonical_url("article_url")).withColumn("article_id", article_key("canonical_url")).withColumn("partition_date", partition_date("published_at"))


def discoveries(hits: DataFrame) -> DataFrame:
    """One row for each hit."""
    rows = canonical_hits(hits).withColumn("discovery_id", discovery_key("article_id", "provider", "outlet_key", "raw_payload_path", "query_text"))
    return conform(rows, DISCOVERY)


def articles(hits: DataFrame, fetched: DataFrame | None = None, keep_body: bool = True) -> DataFrame:
    """One row for each canonical URL: that of its first hit by ``hit_seq``.

    First by an aggregate of structs, which combines before the shuffle: a URL that very many hits share is no
    large group. fetched: (canonical_url, fetch_status, body_text), one row each; others are not_fetched.
    """
    kept = ("article_url", "title", "published_at", "domain", "language", "partition_date")
    first = F.min_by(F.struct(*kept), HIT_SEQ).alias("hit")
    rows = canonical_hits(hits).groupBy("canonical_url", "article_id").agg(first).select("canonical_url", "article_id", F.col("hit.article_url").alias("url"), *[f"hit.{c}" for c in kept[1:]])
    if fetched is not None:
        rows = rows.join(fetched.select("canonical_url", "fetch_status", "body_text"), "canonical_url", "left")
    else:
        rows = rows.withColumns({"fetch_status": F.lit(None).cast("string"), "body_text": F.lit(None).cast("string")})
    rows = rows.withColumn("fetch_status", F.coalesce("fetch_status", F.lit("not_fetched"))).withColumn("body_text", F.coalesce("body_text", F.lit("")) if keep_body else F.lit(""))
    return conform(rows.withColumns({"is_duplicate": F.lit(False), "canonical_article_id": F.lit(None).cast("string")}), FACT_ARTICLE)


def duplicate_rate(hits: DataFrame, url: str = "article_url") -> DataFrame:
    """One row: the share of hits beyond the first of their canonical URL; null without hits."""
    n = F.count(F.lit(1))
    return hits.agg((1 - F.count_distinct(canonical_url(url)) / F.nullif(n, F.lit(0))).alias("duplicate_rate"))


def fetch_status(http_error: Column, extracted: Column, body: Column, least: int = DEFAULTS.dq_min_article_text_length) -> Column:
    """http_error, extractor_unavailable, too_short or success, in that order of precedence."""
    return F.when(http_error, "http_error").when(~extracted, "extractor_unavailable").when(F.length(strip(F.coalesce(body, F.lit("")))) < least, "too_short").otherwise("success")


def provider_status(hits: Column, error: Column | None = None) -> Column:
    found = F.when(hits > 0, "success_hits").otherwise("success_zero")
    return found if error is None else F.when(error.isNotNull() & (error != ""), F.when(error == "http_429", "rate_limited").otherwise("error")).otherwise(found)


def outlet_status(hits: Column, fetched: Column, parsed: Column, entries: Column, in_window: Column) -> Column:
    """How far an outlet got; the order of the tests matters."""
    return F.when(hits > 0, "success_hits").when(fetched == 0, "blocked").when(parsed == 0, "fetched").when(entries == 0, "zero_entries").when(in_window == 0, "parsed").otherwise("zero_hits")


def query_audit(results: DataFrame, now: Column | None = None) -> DataFrame:
    """One row for each provider and candidate; no error is '', secrets are cut from the request's URL."""
    safe = F.array_join(F.transform(F.split(F.coalesce("request_url", F.lit("")), ";"), sanitized_url), ";")
    return conform(results.withColumns({"provider_error_type": F.coalesce("provider_error_type", F.lit("")), "request_url": safe, "_ingested_at": iso_utc(now)}), QUERY_AUDIT)


def bronze_hits(hits: DataFrame, raw_documents: DataFrame, now: Column | None = None) -> DataFrame:
    """Hits with the file of their raw document: (raw_document_key, path, source_url, source_hash); an unknown key
    stays as it is, with nothing beside it. The URL that a hit came from loses its secrets."""
    raw = raw_documents.select(F.col("raw_document_key").alias("raw_payload_path"), F.col("path").alias("_path"), F.col("source_url").alias("_url"), F.col("source_hash").alias("_hash"))
    joined = hits.join(raw, "raw_payload_path", "left")
    joined = joined.withColumns({"_source_url": F.coalesce(sanitized_url("_url"), F.lit("")), "_source_hash": F.coalesce("_hash", F.lit("")), "_ingested_at": iso_utc(now)})
    joined = joined.withColumn("raw_payload_path", F.coalesce("_path", "raw_payload_path")).withColumns({c: F.col(c).cast("string") for c in ("window_start", "window_end") if c in joined.columns})
    return conform(joined, BRONZE_HITS)


def outlet_counters(documents: DataFrame) -> DataFrame:
    """Counters of each outlet from its documents: (outlet_key, doc_seq, fetched, parsed, entry_count,
    window_entry_count, warning, error_type, request_url)."""
    # by URL first, so that an outlet's row holds its distinct URLs and not its documents
    by_url = documents.groupBy("outlet_key", "request_url").agg(
        F.min("doc_seq").alias("doc_seq"), F.count_if("fetched").alias("documents_fetched"), F.count_if("parsed").alias("documents_parsed"), F.sum("entry_count").alias("entry_count"),
        F.sum("window_entry_count").alias("window_entry_count"), F.count_if("warning").alias("warning_count"), F.collect_set(F.nullif(F.col("error_type"), F.lit(""))).alias("error_types"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("doc_seq", "request_url")))
    return by_url.groupBy("outlet_key").agg(
        F.sum("documents_fetched").alias("documents_fetched"), F.sum("documents_parsed").alias("documents_parsed"), F.coalesce(F.sum("entry_count"), F.lit(0)).alias("entry_count"),
        F.coalesce(F.sum("window_entry_count"), F.lit(0)).alias("window_entry_count"), F.sum("warning_count").alias("warning_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("error_types")))).alias("error_types"),
        F.transform(ordered, lambda x: x["request_url"]).alias("request_urls"),
    )


def run_totals(audit: DataFrame) -> DataFrame:
    """One row: queries, hits, errors, providers with hits, and whether the run is partial."""
    failed = F.count_if(F.col("provider_status").isin("rate_limited", "error"))
    return audit.agg(
        F.count(F.lit(1)).alias("query_count"), F.coalesce(F.sum("provider_hit_count"), F.lit(0)).alias("hit_count"), failed.alias("error_count"),
        F.count_distinct(F.when(F.col("provider_hit_count") > 0, F.col("provider"))).alias("providers_with_hits"), F.when(failed > 0, "partial").otherwise("success").alias("status"),
    )


def dedup_within_query(hits: DataFrame) -> DataFrame:
    """Hits of one query without a URL, or with a canonical URL seen before in it, dropped."""
    rows = hits.filter(F.coalesce("article_url", F.lit("")) != "").withColumn("_canonical", canonical_url("article_url"))
    place = F.row_number().over(Window.partitionBy("provider", "leader_id", "query_text", "_canonical").orderBy(HIT_SEQ))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place", "_canonical")
