"""News providers: the curated outlets, the event index and the keyed search API.

Requests are planned as tables, fetched on the executors through a transport that is handed in, and answers are
parsed as expressions. A provider's result is a table of hits and one of audits; what was fetched before an error is kept.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hustings.config import DEFAULTS, OUTLETS, TIERS, Settings
from hustings.functions.dates import api_time, event_time, request_time, within
from hustings.functions.text import event_query, generic_query, outlet_from_domain
from hustings.functions.url import canonical_url
from hustings.operators.contracts import OUTLET_DIAGNOSTIC, SEARCH_HIT, conform
from hustings.operators.matching import screen
from hustings.operators.news import HIT_SEQ, dedup_within_query, outlet_counters, outlet_status, provider_status
from hustings.operators.windows import request_windows, split_near_cap
from hustings.sources.feeds import explode_entries, is_index, parse_documents, wanted_children
from hustings.sources.http import Transport, fetch, fetch_all, without_secrets

EVENT_URL = "https://api.gdeltproject.org/api/v2/doc/doc"
SEARCH_URL = "https://gnews.io/api/v4/search"
CASE_COLUMNS = ["leader_id", "full_name", "commune_name", "dep_code", "city_size_bucket"]


@dataclass
class Found:
    """hits (SEARCH_HIT and hit_seq), audits (one row for each case), raw documents, and diagnostics of outlets."""

    hits: DataFrame
    audits: DataFrame
    raw: DataFrame
    diagnostics: DataFrame | None = None


def outlets(spark: SparkSession, enabled_only: bool = True) -> DataFrame:
    """(outlet_key, display_name, connector_capability, doc_seq, url, kind) of the catalog's feeds and sitemaps."""
    rows, n = [], 0
    for o in OUTLETS.values():
        if o.enabled or not enabled_only:
            for kind, urls in (("feed", o.rss_urls), ("sitemap", o.sitemap_urls)):
                for u in urls:
                    rows.append((o.outlet_key, o.display_name, o.connector_capability, n, u, kind))
                    n += 1
    return spark.createDataFrame(rows, "outlet_key string, display_name string, connector_capability string, doc_seq long, url string, kind string")


# --- curated outlets -----------------------------------------------------------


def curated_bundle(spark: SparkSession, roots: DataFrame, window: tuple[date, date], transport: Transport, s: Settings = DEFAULTS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The outlets' documents, each fetched once: sitemap indexes are followed in rounds, no deeper than the limit.

    Columns: outlet_key, display_name, connector_capability, doc_seq, url, fetched, error_type, request_url, body,
    parsed, entries, index. A bundle has tens of documents an outlet, so a round is a small table; the number of
    rounds is a setting.
    """
    todo, done, seen = roots.select("outlet_key", "display_name", "connector_capability", F.col("doc_seq").cast("double").alias("doc_seq"), "url"), None, None
    for depth in range(s.sitemap_depth + 1):
        if seen is not None:
            todo = todo.join(seen, ["outlet_key", "url"], "left_anti")
        got = fetch_all(todo, transport, s, sleep)
        docs = todo.join(got, "url", "left").withColumn("fetched", F.coalesce(F.col("error_type") == "", F.lit(False))).withColumnRenamed("text", "body")
        docs = parse_documents(docs).withColumn("index", F.col("fetched") & is_index(F.col("body"))).withColumn("depth", F.lit(depth)).cache()
        done = docs if done is None else done.unionByName(docs)
        visited = docs.select("outlet_key", "url")
        seen = visited if seen is None else seen.unionByName(visited)
        children = wanted_children(docs.filter("index"), "body", F.lit(window[0]), s.sitemap_children, ["outlet_key", "display_name", "connector_capability", "doc_seq"])
        todo = children.withColumn("doc_seq", F.col("doc_seq") + (F.col("child_seq") + 1) / F.pow(F.lit(100.0), F.lit(depth + 1))).drop("child_seq").dropDuplicates(["outlet_key", "url"]).cache()
        if depth == s.sitemap_depth or todo.isEmpty():
            break
    return done


def bundle_entries(bundle: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("outlet_key").orderBy("doc_seq"))
    docs = bundle.filter("parsed AND fetched").withColumn("n", number)
    return explode_entries(docs, ["outlet_key", "doc_seq", "n"])


def curated(cases: DataFrame, bundle: DataFrame, read_article: Callable[[DataFrame], DataFrame], s: Settings = DEFAULTS, today: str = "") -> Found:
    """Every case against the shared bundle.

    An entry whose title and URL name the candidate is a hit. One that is only worth a look is read, the first
    ``verification_fetches`` distinct URLs of each case, and is a hit if its text names the candidate.
    read_article: (url) -> (url, text, request_url, error_type) with plain text.
    """
    key = F.concat_ws("_", F.replace(F.col("outlet_key"), F.lit("."), F.lit("_")), F.col("n").cast("string"), F.lit(today or "feed"))
    entries = bundle_entries(bundle).withColumn("raw_document_key", key)
    looked = screen(entries.filter("link <> ''"), cases, F.concat_ws(" ", "title", "link"))
    place = F.struct("doc_seq", "entry_seq")
    sure = looked.filter("is_match").withColumns({"article_url": F.col("link"), "query_strategy": F.lit("rss_sitemap_filter")})
    open_ = looked.filter("NOT is_match")
    first = open_.groupBy("leader_id", "link").agg(F.min(place).alias("at"))
    chosen = first.withColumn("nth", F.row_number().over(Window.partitionBy("leader_id").orderBy("at", "link"))).filter(F.col("nth") <= s.verification_fetches).select("leader_id", "link")
    texts = read_article(chosen.select(F.col("link").alias("url")).distinct()).select(F.col("url").alias("link"), F.col("text").alias("_body"), F.col("request_url").alias("_resolved"))
    read = open_.join(chosen, ["leader_id", "link"]).join(texts, "link").drop("score", "is_match", "needs_verification")
    own = [c for c in read.columns if c not in ("window_start", "window_end", *CASE_COLUMNS)]
    again = screen(read.select(*own, F.col("leader_id").alias("_for")), cases, F.col("_body")).filter("leader_id = _for AND is_match").drop("_for")
    again = again.withColumns({"article_url": F.col("_resolved"), "query_strategy": F.lit("rss_sitemap_body_verify")})
    hits = sure.select(*CASE_COLUMNS, "outlet_key", "title", "published_at", "raw_document_key", "article_url", "query_strategy", "doc_seq", "entry_seq").unionByName(again.select(*CASE_COLUMNS, "outlet_key", "title", "published_at", "raw_document_key", "article_url", "query_strategy", "doc_seq", "entry_seq"))
    hits = hits.withColumns({"provider": F.lit("curated"), "provider_tier": F.lit(TIERS["curated"]), "domain": F.col("outlet_key"), "language": F.lit("fr"), "raw_payload_path": F.col("raw_document_key"), "query_text": generic_query("full_name", F.col("commune_name"))})
    hits = hits.withColumn(HIT_SEQ, F.row_number().over(Window.partitionBy("leader_id").orderBy("doc_seq", "entry_seq", "article_url")))
    hits = conform(hits, SEARCH_HIT + f", {HIT_SEQ} bigint")

    inside = F.size(F.filter("entries", lambda e: within(_entry_day(e), F.col("window_start"), F.col("window_end"))))
    windows = cases.select("window_start", "window_end").distinct()
    counted = bundle.join(F.broadcast(windows), F.lit(True), "left")
    per_outlet = outlet_counters(
        counted.withColumns({"entry_count": F.size("entries"), "window_entry_count": inside, "warning": ~F.col("fetched") | ~(F.col("parsed") | F.col("index")), "error_type": F.when(~F.col("fetched"), F.col("error_type")).when(~(F.col("parsed") | F.col("index")), "parse_error").otherwise("")})
        .withColumn("parsed", F.col("parsed") | F.col("index")).dropDuplicates(["outlet_key", "url"])
    )
    names = bundle.select("outlet_key", "display_name", "connector_capability").distinct()
    per_case = cases.select("leader_id", "full_name", "commune_name").join(F.broadcast(per_outlet.join(names, "outlet_key")), F.lit(True), "left")
    found = hits.groupBy("leader_id", "outlet_key").agg(F.count(F.lit(1)).alias("hit_count"))
    diagnostics = per_case.join(found, ["leader_id", "outlet_key"], "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)))
    status = outlet_status(F.col("hit_count"), F.col("documents_fetched"), F.col("documents_parsed"), F.col("entry_count"), F.col("window_entry_count"))
    diagnostics = conform(diagnostics.withColumns({"outlet_status": status, "provider": F.lit("curated"), "provider_tier": F.lit(TIERS["curated"])}), OUTLET_DIAGNOSTIC)

    whole = bundle.agg(F.count_if("fetched").alias("ok"), F.count_if(~F.col("fetched") | ~(F.col("parsed") | F.col("index"))).alias("warnings"), F.array_join(F.array_sort(F.collect_set("request_url")), ";").alias("request_url"))
    counts = hits.groupBy("leader_id").agg(F.count(F.lit(1)).alias("n"))
    audits = cases.join(counts, "leader_id", "left").join(F.broadcast(whole)).withColumn("provider_hit_count", F.coalesce("n", F.lit(0)))
    audits = audits.withColumns({
        "provider": F.lit("curated"), "provider_tier": F.lit(TIERS["curated"]), "provider_error_type": F.when(F.col("ok") == 0, "all_connectors_failed"),
        "provider_status": F.when(F.col("ok") == 0, "error").otherwise(provider_status(F.col("provider_hit_count"))), "provider_warning_count": F.col("warnings"),
    }).drop("ok", "warnings", "n")
    # the documents that entries come from, under the key that their hits have
    number = F.row_number().over(Window.partitionBy("outlet_key").orderBy("doc_seq"))
    raw = bundle.filter("parsed AND fetched").withColumn("n", number).select(key.alias("raw_document_key"), "outlet_key", "url", F.col("request_url").alias("source_url"), F.col("body").alias("payload"), F.size("entries").alias("row_count"))
    return Found(hits, audits, raw, diagnostics)


def search_outlets(spark: SparkSession, case: DataFrame, transport: Transport, s: Settings = DEFAULTS, sleep: Callable[[float], None] = time.sleep) -> Found:
    """The catalog's outlets searched for one candidate (a row of cases with its window), raw documents included."""
    window = case.select("window_start", "window_end").first()
    bundle = curated_bundle(spark, outlets(spark), tuple(window), transport, s, sleep)
    return curated(case, bundle, article_reader(transport, s, sleep), s, window[1].isoformat())


def _entry_day(e):
    from hustings.functions.dates import feed_time

    return feed_time(e["published"])


def article_reader(transport: Transport, s: Settings = DEFAULTS, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame], DataFrame]:
    """Articles as plain text for matching; an article that can't be had is empty."""
    from hustings.functions.text import strip_html

    def read(urls: DataFrame) -> DataFrame:
        return fetch_all(urls, transport, s, sleep).withColumn("text", F.when(F.col("error_type") == "", strip_html("text")).otherwise(""))

    return read


# --- event index -----------------------------------------------------------------

_EVENT_JSON = "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string,language:string>>>"
_SEARCH_JSON = "struct<articles:array<struct<url:string,title:string,publishedAt:string>>>"


def _ask(requests: DataFrame, transport: Transport, s: Settings, sleep: Callable[[float], None]) -> DataFrame:
    """requests with their answers: body, safe_url, error."""
    out = T.StructType(list(requests.schema.fields)).add("body", "string").add("safe_url", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies = []
            for url in b["request_url"].to_pylist():
                text, safe, error = fetch(url, transport, s, sleep)
                replies.append((text, safe, error))
            cols = list(zip(*replies, strict=True)) if replies else [[], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.string()) for c in cols]], [*b.schema.names, "body", "safe_url", "error"])

    return requests.mapInArrow(run, out)


def event_requests(cases: DataFrame, mode: str, s: Settings = DEFAULTS) -> DataFrame:
    """One request for each case and window: query_text, query_strategy and the URL."""
    query = event_query("full_name", F.col("commune_name"), mode)
    url = F.concat(
        F.lit(EVENT_URL + "?query="), F.url_encode(query), F.lit(f"&mode=artlist&maxrecords={s.gdelt_max_records}&startdatetime="), request_time("request_start"), F.lit("&enddatetime="), request_time("request_end", end=True), F.lit("&format=json&sourcelang=French")
    )
    return cases.withColumns({"query_text": query, "query_strategy": F.lit(mode), "request_url": url})


def event_index(cases: DataFrame, transport: Transport, s: Settings = DEFAULTS, sleep: Callable[[float], None] = time.sleep) -> Found:
    """The event index: the whole window first, precisely and then relaxed where nothing came; cases with hits again
    in windows of seven days, and those windows that are nearly full day by day. Answers before an error are kept."""
    base = cases.withColumns({"request_start": F.col("window_start"), "request_end": F.col("window_end")})

    def answers(requests: DataFrame) -> DataFrame:
        got = _ask(requests, transport, s, sleep)
        parsed = F.from_json("body", _EVENT_JSON)
        bad = (F.col("error") == "") & F.get_json_object("body", "$").isNull()
        return got.withColumn("articles", F.coalesce(parsed["articles"], F.array().cast("array<struct<url:string,title:string,seendate:string,domain:string,language:string>>"))).withColumn("error", F.when(bad, "parse_error").otherwise(F.col("error"))).cache()

    precise = answers(event_requests(base, "precise", s))
    empty = precise.filter("error = '' AND size(articles) = 0").select(*base.columns)
    relaxed = answers(event_requests(empty, "relaxed", s))
    probe = precise.unionByName(relaxed).withColumn("step", F.lit(0))
    full = probe.filter(F.size("articles") > 0).select(*base.columns, F.col("query_strategy").alias("mode"), F.size("articles").alias("n"))
    # a window of up to seven days needs no second look unless it is nearly full
    wide = full.filter((F.datediff("request_end", "request_start") >= 7) | (F.col("n") >= int(s.gdelt_max_records * s.gdelt_near_cap)))

    def again(windows: DataFrame, step: int) -> DataFrame:
        parts = [answers(event_requests(windows.filter(F.col("mode") == m).select(*base.columns), m, s)) for m in ("precise", "relaxed")]
        return parts[0].unionByName(parts[1]).withColumn("step", F.lit(step))

    weekly = again(request_windows(wide), 1)
    crowded = weekly.withColumn("mode", F.col("query_strategy")).filter((F.size("articles") >= int(s.gdelt_max_records * s.gdelt_near_cap)) & (F.col("request_end") > F.col("request_start")))
    daily = again(split_near_cap(crowded.select(*base.columns, "mode"), F.lit(s.gdelt_max_records)), 2)
    every = probe.unionByName(weekly).unionByName(daily)
    key = F.concat_ws("_", "query_strategy", F.date_format("request_start", "yyyy-MM-dd"), F.date_format("request_end", "yyyy-MM-dd"))
    rows = every.withColumn("raw_document_key", key).select("*", F.posexplode("articles").alias("entry_seq", "a"))
    domain = outlet_from_domain(F.col("a.domain"))
    hits = rows.withColumns({
        "provider": F.lit("gdelt"), "provider_tier": F.lit(TIERS["gdelt"]), "article_url": F.coalesce("a.url", F.lit("")), "title": F.coalesce("a.title", F.lit("")), "published_at": event_time("a.seendate"),
        "domain": domain, "outlet_key": outlet_from_domain(F.col("a.domain"), "gdelt"), "language": F.lower(F.when(F.coalesce("a.language", F.lit("")) == "", "fr").otherwise(F.col("a.language"))), "raw_payload_path": F.col("raw_document_key"),
    })
    hits = hits.withColumn(HIT_SEQ, F.row_number().over(Window.partitionBy("leader_id").orderBy("step", "request_start", "query_strategy", "entry_seq")))
    # an article that several windows gave is one hit of the case
    hits = hits.withColumn("_c", canonical_url("article_url")).withColumn("_n", F.row_number().over(Window.partitionBy("leader_id", "_c").orderBy(HIT_SEQ))).filter("_n = 1")
    hits = conform(hits, SEARCH_HIT + f", {HIT_SEQ} bigint")
    raw = every.filter("error = ''").select("leader_id", key.alias("raw_document_key"), F.col("safe_url").alias("source_url"), F.col("body").alias("payload"), F.size("articles").alias("row_count"), F.date_format("request_start", "yyyy-MM-dd").alias("partition_date"))
    return Found(hits, _audits(cases, hits, every, "gdelt", TIERS["gdelt"]), raw)


def _audits(cases: DataFrame, hits: DataFrame, answers: DataFrame, provider: str, tier: str) -> DataFrame:
    counts = hits.groupBy("leader_id").agg(F.count(F.lit(1)).alias("provider_hit_count"))
    errors = answers.groupBy("leader_id").agg(F.max(F.when(F.col("error") != "", F.col("error"))).alias("provider_error_type"), F.min("safe_url").alias("request_url"))
    out = cases.join(counts, "leader_id", "left").join(errors, "leader_id", "left").withColumn("provider_hit_count", F.coalesce("provider_hit_count", F.lit(0)))
    return out.withColumns({"provider": F.lit(provider), "provider_tier": F.lit(tier), "provider_status": provider_status(F.col("provider_hit_count"), F.col("provider_error_type")), "provider_warning_count": F.lit(0).cast("bigint")})


# --- keyed search API ----------------------------------------------------------------


def search_api(cases: DataFrame, transport: Transport, s: Settings = DEFAULTS, sleep: Callable[[float], None] = time.sleep) -> Found:
    """The keyed search API: pages in turn until one is short or fails; earlier pages are kept. Without a key every
    query is an error, and nothing is asked."""
    query = generic_query("full_name", F.col("commune_name"))
    planned = cases.withColumn("query_text", query)
    out = T.StructType(list(planned.schema.fields)).add("page", "integer").add("body", "string").add("safe_url", "string").add("error", "string")
    key, size, pages = s.gnews_api_key, s.gnews_max_articles_per_page, s.gnews_max_pages_per_query

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, replies = [], []
            for i, (q, start, end) in enumerate(zip(*(b[c].to_pylist() for c in ("query_text", "window_start", "window_end")), strict=True)):
                if not key:
                    rows.append(i)
                    replies.append((1, "", SEARCH_URL, "missing_api_key"))
                    continue
                for page in range(1, pages + 1):
                    url = SEARCH_URL + "?" + urlencode({"q": q, "lang": "fr", "country": "fr", "max": size, "page": page, "from": f"{start}T00:00:00Z", "to": f"{end}T23:59:59Z", "apikey": key})
                    text, safe, error = fetch(url, transport, s, sleep)
                    count = 0
                    if not error:
                        try:
                            count = len(json.loads(text).get("articles") or [])
                        except (ValueError, AttributeError):
                            error = "parse_error"
                    rows.append(i)
                    replies.append((page, text, safe or without_secrets(url), error))
                    if error or count < size:
                        break
            part = b.take(pa.array(rows, pa.int64()))
            cols = list(zip(*replies, strict=True)) if replies else [[]] * 4
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)]], [*part.schema.names, "page", "body", "safe_url", "error"])

    answers = planned.mapInArrow(run, out).withColumn("articles", F.coalesce(F.from_json("body", _SEARCH_JSON)["articles"], F.array().cast("array<struct<url:string,title:string,publishedAt:string>>"))).cache()
    doc = F.concat(F.lit("search_"), F.date_format("window_start", "yyyy-MM-dd"), F.lit("_"), F.col("leader_id"), F.lit("_page_"), F.col("page").cast("string"))
    rows = answers.withColumn("raw_document_key", doc).select("*", F.posexplode("articles").alias("entry_seq", "a"))
    from hustings.functions.url import domain as domain_of

    host = domain_of(F.coalesce("a.url", F.lit("")))
    hits = rows.withColumns({
        "provider": F.lit("gnews"), "provider_tier": F.lit(TIERS["gnews"]), "article_url": F.coalesce("a.url", F.lit("")), "title": F.coalesce("a.title", F.lit("")), "published_at": api_time("a.publishedAt"),
        "domain": host, "outlet_key": host, "language": F.lit("fr"), "query_strategy": F.lit("gnews_search"), "raw_payload_path": F.col("raw_document_key"),
    })
    hits = hits.withColumn(HIT_SEQ, F.row_number().over(Window.partitionBy("leader_id").orderBy("page", "entry_seq")))
    hits = dedup_within_query(conform(hits, SEARCH_HIT + f", {HIT_SEQ} bigint"))
    raw = answers.filter("error = ''").select("leader_id", doc.alias("raw_document_key"), F.col("safe_url").alias("source_url"), F.col("body").alias("payload"), F.size("articles").alias("row_count"), F.date_format("window_start", "yyyy-MM-dd").alias("partition_date"))
    return Found(hits, _audits(cases, hits, answers, "gnews", TIERS["gnews"]), raw)


def provider(name: str) -> str:
    """The name, if it is a provider's."""
    if name not in ("curated", "gdelt", "gnews"):
        raise ValueError(f"Unknown provider: {name!r}")
    return name
