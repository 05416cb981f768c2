"""Queries over the star-schema test tables, one or more for each operator, with the SQL of the same rows.

A customer stands for a commune (population: c_acctbal x 20), a nation for a département, a region for a région,
an order for a candidate (gender: o_orderstatus, P invalid), part names for names, pages for articles,
documents for texts, events for hits and runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.config import ELECTION_KEYWORDS, NUANCE_BLOCS, OTHER_BLOC, TRACKING_KEYS
from hustings.functions import keys, text, url
from hustings.functions.dates import event_time, feed_time, fresh_enough, partition_date, request_time, within
from hustings.functions.similarity import indel_ratio, sort_tokens
from hustings.operators import benchmark as bench
from hustings.operators import marts, news
from hustings.operators.contracts import conform, rename
from hustings.operators.dims import collision_counts, leaders_only, match_incumbents, not_excluded, second_round, size_bucket
from hustings.operators.matching import match_terms, signals
from hustings.operators.quality import REASON, first_of, membership, null_rates, reason_counts, require_unique, split, tag
from hustings.operators.sampling import draw_key, stratified
from hustings.operators.windows import provider_start, request_windows, split_near_cap
from hustings.plans.lineage import insert_if_absent, upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




def population() -> Column:
    return (F.col("c_acctbal") * 20).cast("double")


POP_SQL = "CAST(trunc(c_acctbal * 20) AS BIGINT)"
BUCKET_SQL = f"CASE WHEN {POP_SQL} IS NULL OR {POP_SQL} <= 0 THEN 'excluded' WHEN {POP_SQL} >= 100000 THEN 'large' WHEN {POP_SQL} >= 20000 THEN 'medium' WHEN {POP_SQL} >= 3500 THEN 'small' ELSE 'excluded' END"


def communes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_custkey").alias("commune_insee"), F.col("c_name").alias("commune_name"), F.col("c_nationkey").alias("dep"), population().alias("population"), "c_mktsegment").withColumn("city_size_bucket", size_bucket(F.col("population")))


# --- projection ------------------------------------------------------------------------------------------------


@query("size_bucket", f"SELECT c_custkey, {POP_SQL} AS population, {BUCKET_SQL} AS bucket FROM customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", population().try_cast("bigint").alias("population"), size_bucket(population()).alias("bucket"))


@query("rename_contract", "SELECT CAST(n_nationkey AS VARCHAR) AS commune_insee, n_name AS commune_name, CAST(n_regionkey AS VARCHAR) AS reg_code, CAST(NULL AS VARCHAR) AS epci_name FROM nation")
def _(spark, d):
    df = rename(t(spark, d, "nation"), {"n_nationkey": "commune_insee", "n_name": "commune_name", "n_regionkey": "reg_code", "absent": "nothing"})
    return conform(df, "commune_insee string, commune_name string, reg_code string, epci_name string")


@query("full_name_build", "SELECT c_custkey, trim(concat(c_name, ' ', coalesce(nullif(c_mktsegment, 'BUILDING'), ''))) AS full_name FROM customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.full_name(F.col("c_name"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).alias("full_name"))


@query("surrogate_key", "SELECT c_custkey, md5(concat(c_name, '|', c_custkey)) AS leader_id, md5(concat(c_name, ':', c_mktsegment, ':', c_nationkey, ':', '', ':', c_custkey)) AS discovery_id FROM customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", keys.leader_key("c_name", "c_custkey").alias("leader_id"), keys.discovery_key("c_name", "c_mktsegment", "c_nationkey", F.lit(None).cast("string"), "c_custkey").alias("discovery_id"))


_CODES = {"1-URGENT": "LDVG", "2-HIGH": " lrn ", "3-MEDIUM": "LR", "5-LOW": "llr"}


def _code() -> Column:
    c = F.lit(None).cast("string")
    for k, v in _CODES.items():
        c = F.when(F.col("o_orderpriority") == k, v).otherwise(c)
    return c


_CODE_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items()) + " END"
_NUANCE_SQL = "CASE WHEN starts_with(u, 'L') AND length(u) > 1 THEN substr(u, 2) ELSE u END"


@query(
    "nuance_group",
    f"WITH a AS (SELECT o_orderkey, upper(trim(coalesce({_CODE_SQL}, ''))) AS u FROM orders), b AS (SELECT o_orderkey, {_NUANCE_SQL} AS nuance FROM a) "
    "SELECT o_orderkey, nuance, CASE nuance " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NUANCE_BLOCS.items()) + f" ELSE '{OTHER_BLOC}' END AS bloc FROM b",
)
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey", text.normalize_nuance(_code()).alias("nuance"), text.nuance_bloc(_code()).alias("bloc"))


@query("numeric_coercion", "SELECT event_id, TRY_CAST(replace(json_extract_string(props, '$.k'), 'x', '') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.replace(F.get_json_object("props", "$.k"), F.lit("x"), F.lit("")).try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("partition_date", "SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS partition_date FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", partition_date(F.when(F.col("event_type") != "view", F.col("ts"))).alias("partition_date"))


# --- filters ---------------------------------------------------------------------------------------------------


@query("com_filter", "SELECT n_nationkey, n_name FROM nation WHERE CASE WHEN n_regionkey = 1 THEN 'COM' ELSE 'ARM' END = 'COM'")
def _(spark, d):
    df = t(spark, d, "nation").withColumn("typecom", F.when(F.col("n_regionkey") == 1, "COM").otherwise("ARM"))
    return df.filter("typecom = 'COM'").select("n_nationkey", "n_name")


@query("leader_filter", "SELECT o_orderkey FROM orders WHERE lower(trim(CASE o_orderstatus WHEN 'F' THEN ' OUI ' WHEN 'O' THEN 'Non' END)) = 'oui'")
def _(spark, d):
    flag = F.when(F.col("o_orderstatus") == "F", " OUI ").when(F.col("o_orderstatus") == "O", "Non")
    return leaders_only(t(spark, d, "orders").withColumn("is_list_leader", flag)).select("o_orderkey")


@query("leader_filter_position", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE trim(concat(' ', l_linenumber)) = '1' GROUP BY ALL")
def _(spark, d):
    df = t(spark, d, "lineitem").withColumn("position_on_list", F.concat(F.lit(" "), F.col("l_linenumber").cast("string")))
    return leaders_only(df).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("not_excluded_keeps_null", f"SELECT o_orderkey, bucket FROM orders LEFT JOIN (SELECT c_custkey, {BUCKET_SQL} AS bucket FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey WHERE bucket IS DISTINCT FROM 'excluded'")
def _(spark, d):
    c = t(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select("c_custkey", size_bucket(population()).alias("bucket"))
    o = t(spark, d, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "left").filter(not_excluded("bucket")).select("o_orderkey", "bucket")


@query("window_bounds_inclusive", "SELECT event_id FROM events WHERE event_type = 'view' OR CAST(ts AS DATE) BETWEEN (SELECT CAST(min(ts) AS DATE) + 1 FROM events) AND (SELECT CAST(min(ts) AS DATE) + 3 FROM events)")
def _(spark, d):
    e = t(spark, d, "events")
    low = F.broadcast(e.agg(F.to_date(F.min("ts")).alias("low")))
    return e.join(low).filter(within(F.when(F.col("event_type") != "view", F.col("ts")), F.date_add("low", 1), F.date_add("low", 3))).select("event_id")


@query("lastmod_pruning", "SELECT event_id FROM events WHERE event_type = 'view' OR CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 3 FROM events)")
def _(spark, d):
    e = t(spark, d, "events")
    high = F.broadcast(e.agg(F.date_sub(F.to_date(F.max("ts")), 2).alias("start")))
    return e.join(high).filter(fresh_enough(F.when(F.col("event_type") != "view", F.col("ts")), F.col("start"))).select("event_id")


@query("required_fields", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'gender' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'name' END) AS missing FROM orders")
def _(spark, d):
    fields = {"name": F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.col("o_orderpriority")), "gender": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))}
    return t(spark, d, "orders").select("o_orderkey", F.array_join(text.missing_fields(fields), ",").alias("missing"))


# --- dimensions and quarantine ---------------------------------------------------------------------------------

_DIM_SQL = f"""
    WITH seats AS (SELECT n_nationkey AS dep, n_name AS dep_name FROM nation WHERE n_regionkey <> 2),
    j AS (SELECT nullif(c_custkey % 1400, 7) AS commune_insee, c_custkey AS seq, dep_name, {BUCKET_SQL} AS bucket FROM customer LEFT JOIN seats ON c_nationkey = dep),
    g AS (SELECT *, CASE WHEN commune_insee IS NULL THEN 'commune_insee is null' END AS r1 FROM j),
    h AS (SELECT *, row_number() OVER (PARTITION BY commune_insee, r1 IS NULL ORDER BY seq) AS place FROM g),
    tagged AS (SELECT commune_insee, seq, dep_name, bucket, CASE WHEN r1 IS NOT NULL THEN r1 WHEN place > 1 THEN 'duplicate commune_insee' WHEN bucket = 'small' THEN 'invalid city_size_bucket' END AS reason FROM h)
"""


def _dim_tagged(spark: SparkSession, d: str) -> DataFrame:
    seats = t(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dep_name"))
    rows = t(spark, d, "customer").join(F.broadcast(seats), "c_nationkey", "left")
    rows = rows.select(F.nullif(F.col("c_custkey") % 1400, F.lit(7)).alias("commune_insee"), F.col("c_custkey").alias("seq"), "dep_name", size_bucket(population()).alias("bucket"))
    tagged = tag(rows, [(F.col("commune_insee").isNull(), "commune_insee is null")], "commune_insee", ["seq"], "duplicate commune_insee")
    return tagged.withColumn(REASON, F.when(F.col(REASON).isNull() & (F.col("bucket") == "small"), "invalid city_size_bucket").otherwise(F.col(REASON)))


@query("commune_dim", _DIM_SQL + "SELECT commune_insee, seq, dep_name, bucket FROM tagged WHERE reason IS NULL")
def _(spark, d):
    return split(_dim_tagged(spark, d)).clean


@query("commune_rejected", _DIM_SQL + "SELECT CAST(commune_insee AS VARCHAR) AS commune_insee, seq, dep_name, bucket, reason AS _rejection_reason FROM tagged WHERE reason IS NOT NULL")
def _(spark, d):
    return split(_dim_tagged(spark, d)).rejected.withColumn("commune_insee", F.col("commune_insee").cast("string"))


@query("quarantine_summary", _DIM_SQL + "SELECT coalesce(reason, 'clean') AS reason, count(*) AS n FROM tagged GROUP BY 1")
def _(spark, d):
    return reason_counts(_dim_tagged(spark, d))


@query("leader_dim_enrich", f"SELECT o_orderkey, o_custkey, c_name AS commune_name, {BUCKET_SQL} AS city_size_bucket FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    place = require_unique(communes(spark, d).select(F.col("commune_insee").alias("o_custkey"), "commune_name", "city_size_bucket"), ["o_custkey"], "communes")
    return t(spark, d, "orders").select("o_orderkey", "o_custkey").join(place, "o_custkey", "left").select("o_orderkey", "o_custkey", "commune_name", "city_size_bucket")


@query("advanced_flag", "SELECT o_orderkey, CASE WHEN trim(o_orderpriority) <> '' THEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) END AS advanced_to_tour2 FROM orders")
def _(spark, d):
    name = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    second = t(spark, d, "lineitem").select(F.lit("x").alias("commune_insee"), name(F.col("l_orderkey")).alias("full_name"), F.col("l_linenumber").cast("string").alias("position_on_list"))
    leaders = t(spark, d, "orders").select("o_orderkey", F.lit("x").alias("commune_insee"), name(F.col("o_orderkey")).alias("full_name"))
    return second_round(leaders, second).select("o_orderkey", "advanced_to_tour2")


@query(
    "referential_quarantine",
    "WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'), g AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'gender not in {M, F}' "
    "WHEN NOT EXISTS (SELECT 1 FROM c WHERE c_custkey = o_custkey) THEN 'commune_insee not in dim_commune' END AS r1 FROM orders), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, r1 IS NULL ORDER BY o_orderkey) AS place FROM g) "
    "SELECT o_orderkey, o_custkey, coalesce(r1, CASE WHEN place > 1 THEN 'duplicate leader_id' END) AS _rejection_reason FROM h",
)
def _(spark, d):
    known = t(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    rows = membership(t(spark, d, "orders"), known, ["o_custkey"], "known")
    checks = [(~F.col("o_orderstatus").isin("F", "O"), "gender not in {M, F}"), (~F.col("known"), "commune_insee not in dim_commune")]
    return tag(rows, checks, "o_custkey", ["o_orderkey"], "duplicate leader_id").select("o_orderkey", "o_custkey", REASON)


@query("null_rate", "SELECT avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) AS o_orderstatus, 0.0::DOUBLE AS o_custkey FROM orders")
def _(spark, d):
    return null_rates(t(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))), ["o_orderstatus", "o_custkey"])


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("dedupe_keep_first", f"SELECT {', '.join(_LINE)} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE[2:])}) = 1")
def _(spark, d):
    return first_of(t(spark, d, "lineitem").select(*_LINE), ["l_orderkey", "l_linenumber"], _LINE[2:])


@query("name_collision", "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY regexp_replace(trim(translate(upper(p_name), '-''’', '   ')), '\\s+', ' ', 'g')) AS same_name_candidate_count FROM part")
def _(spark, d):
    return collision_counts(t(spark, d, "part").select("p_partkey", "p_name"), "p_name")


@query("collision_summary", "SELECT max(n) AS most, count(*) AS names FROM (SELECT count(*) AS n FROM part GROUP BY upper(trim(p_name)))")
def _(spark, d):
    return collision_counts(t(spark, d, "part"), "p_name").agg(F.max("same_name_candidate_count").alias("most"), F.count_distinct(text.normalize_name("p_name")).alias("names"))


# --- aggregates ------------------------------------------------------------------------------------------------


@query("group_counts", f"SELECT {BUCKET_SQL} AS bucket, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def _(spark, d):
    return communes(spark, d).groupBy(F.col("city_size_bucket").alias("bucket"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "region_diversity",
    "WITH c AS (SELECT n_regionkey AS reg, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) "
    "SELECT count(*) AS regions, (SELECT reg FROM c ORDER BY n DESC, reg LIMIT 1) AS crowded, string_agg(CAST(reg AS VARCHAR), ',' ORDER BY reg) AS codes FROM c",
)
def _(spark, d):
    n = F.broadcast(t(spark, d, "nation"))
    counts = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("reg")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("regions"), F.max_by("reg", F.struct("n", -F.col("reg"))).alias("crowded"), F.array_join(F.sort_array(F.collect_set("reg")).cast("array<string>"), ",").alias("codes"))


@query("duplicate_rate", "SELECT 1 - count(DISTINCT url) * 1.0::DOUBLE / count(*) AS duplicate_rate FROM (SELECT user_id AS url FROM events)")
def _(spark, d):
    hits = t(spark, d, "events").select(F.concat(F.lit("HTTPS://www.site.fr/a/"), F.col("user_id").cast("string"), F.lit("/?utm_source=x"), F.col("event_id").cast("string")).alias("article_url"))
    return news.duplicate_rate(hits)


def _audit(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("value") < 10, "rate_limited").when(F.col("value") < 20, "error").when(F.col("user_id") % 2 == 0, "success_hits").otherwise("success_zero")
    return t(spark, d, "events").select(F.col("event_id").alias("leader_id"), F.col("event_type").alias("provider"), status.alias("provider_status"), F.when(status == "success_hits", F.col("user_id") % 7).otherwise(0).alias("provider_hit_count"))


_AUDIT_SQL = "WITH a AS (SELECT *, CASE WHEN value < 10 THEN 'rate_limited' WHEN value < 20 THEN 'error' WHEN user_id % 2 = 0 THEN 'success_hits' ELSE 'success_zero' END AS status FROM events), b AS (SELECT event_id, event_type AS provider, status, CASE WHEN status = 'success_hits' THEN user_id % 7 ELSE 0 END AS hits FROM a) "


@query("availability", _AUDIT_SQL + "SELECT round(avg(CASE WHEN status IN ('success_hits', 'success_zero') THEN 1.0 ELSE 0.0 END), 9) AS provider_availability_rate FROM b")
def _(spark, d):
    return bench.availability(_audit(spark, d)).select(F.round("provider_availability_rate", 9).alias("provider_availability_rate"))


@query(
    "run_totals",
    _AUDIT_SQL + "SELECT count(*) AS query_count, CAST(sum(hits) AS BIGINT) AS hit_count, count(*) FILTER (status IN ('rate_limited', 'error')) AS error_count, count(DISTINCT CASE WHEN hits > 0 THEN provider END) AS providers_with_hits, "
    "CASE WHEN count(*) FILTER (status IN ('rate_limited', 'error')) > 0 THEN 'partial' ELSE 'success' END AS status FROM b",
)
def _(spark, d):
    return news.run_totals(_audit(spark, d))


@query("provider_audit_join", "WITH q AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL) SELECT e.event_id, e.user_id, e.event_type, CAST(q.n AS VARCHAR) AS provider_hit_count FROM events e LEFT JOIN q USING (user_id, event_type)")
def _(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    q = require_unique(e.filter("value > 50").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("provider_hit_count")), ["user_id", "event_type"], "audit")
    return e.join(q, ["user_id", "event_type"], "left").select("event_id", "user_id", "event_type", F.col("provider_hit_count").cast("string").alias("provider_hit_count"))


@query(
    "outlet_diagnostics",
    "WITH a AS (SELECT source, count(*) FILTER (lang = 'en') AS fetched, count(*) FILTER (n_chars > 1000 AND lang = 'en') AS parsed, CAST(sum(CASE WHEN n_chars > 9000 THEN 1 ELSE 0 END) AS BIGINT) AS entries, count(*) FILTER (lang = 'es' AND n_chars > 12000) AS hits FROM documents GROUP BY source) "
    "SELECT source AS outlet_key, fetched AS documents_fetched, parsed AS documents_parsed, entries AS entry_count, hits AS hit_count, CASE WHEN hits > 0 THEN 'success_hits' WHEN fetched = 0 THEN 'blocked' WHEN parsed = 0 THEN 'fetched' WHEN entries = 0 THEN 'zero_entries' WHEN entries = 1 THEN 'parsed' ELSE 'zero_hits' END AS outlet_status FROM a",
)
def _(spark, d):
    docs = t(spark, d, "documents").select(
        F.col("source").alias("outlet_key"), F.col("doc_id").alias("doc_seq"), (F.col("lang") == "en").alias("fetched"), ((F.col("n_chars") > 1000) & (F.col("lang") == "en")).alias("parsed"), (F.col("n_chars") > 9000).cast("int").alias("entry_count"),
        F.lit(0).alias("window_entry_count"), F.lit(False).alias("warning"), F.lit("").alias("error_type"), F.lit("u").alias("request_url"), ((F.col("lang") == "es") & (F.col("n_chars") > 12000)).alias("hit"),
    )
    counters = news.outlet_counters(docs).join(docs.groupBy("outlet_key").agg(F.count_if("hit").alias("hit_count")), "outlet_key")
    status = news.outlet_status(F.col("hit_count"), F.col("documents_fetched"), F.col("documents_parsed"), F.col("entry_count"), F.col("entry_count") - 1)
    return counters.select("outlet_key", "documents_fetched", "documents_parsed", "entry_count", "hit_count", status.alias("outlet_status"))


@query("outlet_error_sets", "SELECT source AS outlet_key, coalesce(string_agg(DISTINCT nullif(lang, 'en'), ',' ORDER BY nullif(lang, 'en')), '') AS error_types, count(DISTINCT doc_id % 3) AS urls FROM documents GROUP BY source")
def _(spark, d):
    docs = t(spark, d, "documents").select(
        F.col("source").alias("outlet_key"), F.col("doc_id").alias("doc_seq"), F.lit(True).alias("fetched"), F.lit(True).alias("parsed"), F.lit(1).alias("entry_count"), F.lit(0).alias("window_entry_count"), F.lit(False).alias("warning"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("error_type"), (F.col("doc_id") % 3).cast("string").alias("request_url"),
    )
    return news.outlet_counters(docs).select("outlet_key", F.array_join("error_types", ",").alias("error_types"), F.size("request_urls").cast("bigint").alias("urls"))


# --- names and texts -------------------------------------------------------------------------------------------

_NAME_SQL = r"trim(regexp_replace(regexp_replace(strip_accents(translate(upper(replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), 'ß', 'SS')), '-''’', '   ')), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g'))"
_MATCH_SQL = "trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


@query("normalize_name", f"SELECT doc_id, md5({_NAME_SQL.format(c='text')}) AS name_md5, length({_NAME_SQL.format(c='text')}) AS n FROM documents")
def _(spark, d):
    named = t(spark, d, "documents").select("doc_id", text.normalize_name("text").alias("name"))
    return named.select("doc_id", F.md5("name").alias("name_md5"), F.length("name").cast("bigint").alias("n"))


@query("normalize_text", f"SELECT doc_id, {_MATCH_SQL.format(c='text')} AS normalized FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", text.normalize_match("text").alias("normalized"))


@query("match_tokens", f"SELECT doc_id, len(list_filter(string_split({_MATCH_SQL.format(c='text')}, ' '), lambda x: length(x) >= 3)) AS tokens, contains({_MATCH_SQL.format(c='text')}, 'ion') OR contains({_MATCH_SQL.format(c='text')}, 'keit') AS found FROM documents")
def _(spark, d):
    found = text.any_token(text.normalize_match("text"), F.array(F.lit("ion"), F.lit("keit")))
    return t(spark, d, "documents").select("doc_id", F.size(text.match_tokens("text")).cast("bigint").alias("tokens"), found.alias("found"))


_TITLE_SQL = "array_to_string(list_transform(regexp_extract_all({c}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda x: concat(upper(substr(x, 1, 1)), lower(substr(x, 2)))), '')"


@query("title_case", f"SELECT c_custkey, {_TITLE_SQL.format(c='s')} AS title FROM (SELECT c_custkey, concat(lower(c_mktsegment), '-', upper(c_name), '''le ', 'ÉMILE') AS s FROM customer)")
def _(spark, d):
    s = F.concat(F.lower("c_mktsegment"), F.lit("-"), F.upper("c_name"), F.lit("'le "), F.lit("ÉMILE"))
    return t(spark, d, "customer").select("c_custkey", text.title_case(s).alias("title"))


@query(
    "candidate_aliases",
    "WITH a AS (SELECT p_partkey, string_split(concat('LE-', upper(p_name), ' Élise'), ' ') AS w FROM part), "
    "b AS (SELECT p_partkey, concat(list_extract(w, len(w)), ' ', " + _TITLE_SQL.format(c="array_to_string(list_slice(w, 1, len(w) - 1), ' ')") + ") AS spoken FROM a) "
    "SELECT p_partkey, spoken, strip_accents(spoken) AS plain, regexp_replace(trim(translate(strip_accents(spoken), '-''', '  ')), '\\s+', ' ', 'g') AS normalized FROM b",
)
def _(spark, d):
    a = text.aliases(F.concat(F.lit("LE-"), F.upper("p_name"), F.lit(" Élise")))
    return t(spark, d, "part").select("p_partkey", a["natural_accented"].alias("spoken"), a["natural_deaccented"].alias("plain"), a["normalized"].alias("normalized"))


@query(
    "search_queries",
    "WITH a AS (SELECT p_partkey, p_brand, concat('Élise ', " + _TITLE_SQL.format(c="p_name") + ") AS n FROM (SELECT DISTINCT p_partkey, p_brand, p_name FROM part)) "
    "SELECT p_partkey, concat('\"', n, '\" AND \"', p_brand, '\" AND (municipales OR maire OR mairie OR liste)') AS precise, concat('\"', strip_accents(n), '\" AND \"', p_brand, '\"') AS relaxed, concat('\"', n, '\" \"', p_brand, '\" (municipales OR maire OR mairie OR liste)') AS generic FROM a",
)
def _(spark, d):
    name, place = F.concat("p_name", F.lit(" Élise")), F.col("p_brand")
    return t(spark, d, "part").select("p_partkey", text.event_query(name, place).alias("precise"), text.event_query(name, place, "relaxed").alias("relaxed"), text.generic_query(name, place).alias("generic"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("leader_id"), F.concat(F.lit("THE ONES "), F.substring("n_name", 1, 3), F.lit(" Ing")).alias("full_name"), F.concat(F.lit("The-"), F.col("n_name")).alias("commune_name"))


_SIGNAL_SQL = f"""
    WITH c AS (SELECT n_nationkey AS leader_id, lower(substr(n_name, 1, 3)) AS mid, lower(n_name) AS place FROM nation),
    m AS (SELECT c.*, list_filter(string_split(concat('the ones ', trim(regexp_replace(mid, '[^a-z0-9]+', ' ', 'g'))), ' '), lambda x: length(x) >= 3) AS surname, list_filter(string_split(trim(regexp_replace(concat('the ', place), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3) AS commune,
          concat('ing the ones ', trim(regexp_replace(mid, '[^a-z0-9]+', ' ', 'g'))) AS variant FROM c),
    d AS (SELECT doc_id, {_MATCH_SQL.format(c='text')} AS x FROM documents),
    s AS (SELECT doc_id, leader_id, contains(x, variant) AS full_name, len(list_filter(surname, lambda k: contains(x, k))) > 0 AS surname, contains(x, 'ing') AS given, len(list_filter(commune, lambda k: contains(x, k))) > 0 AS commune,
          contains(x, 'municipales') OR contains(x, 'maire') OR contains(x, 'mairie') OR contains(x, 'liste') AS election FROM d, m),
    r AS (SELECT *, 5 * full_name::INT + 2 * surname::INT + given::INT + 2 * commune::INT + election::INT AS score FROM s), w AS (SELECT * FROM r WHERE score > 0),
    f AS (SELECT *, full_name OR (surname AND given) OR (surname AND commune) OR (score >= 5 AND surname) AS is_match FROM w)
"""


def _signalled(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    docs = t(spark, d, "documents").select("doc_id", text.normalize_match("text").alias("x"))
    s = signals(F.col("x"))
    # containment has no key: the cohort, a nation each, is broadcast, and pairs without a signal don't leave the join
    return docs.join(F.broadcast(match_terms(_cases(spark, d))), s.score > 0), s


@query("match_score", _SIGNAL_SQL + "SELECT doc_id, leader_id, CAST(score AS BIGINT) AS score FROM f")
def _(spark, d):
    df, s = _signalled(spark, d)
    return df.select("doc_id", "leader_id", s.score.cast("bigint").alias("score"))


@query("match_decision", _SIGNAL_SQL + "SELECT doc_id, leader_id, is_match FROM f")
def _(spark, d):
    df, s = _signalled(spark, d)
    return df.select("doc_id", "leader_id", s.matches.alias("is_match"))


@query("needs_verification", _SIGNAL_SQL + "SELECT doc_id, leader_id, is_match OR (commune AND election) OR (surname AND election) OR score >= 3 AS needed FROM f")
def _(spark, d):
    df, s = _signalled(spark, d)
    return df.select("doc_id", "leader_id", s.worth_reading.alias("needed"))


@query("token_sort", "SELECT DISTINCT p_name, array_to_string(list_sort(string_split(upper(p_name), ' ')), ' ') AS sorted FROM part")
def _(spark, d):
    return t(spark, d, "part").select("p_name", sort_tokens(F.upper("p_name")).alias("sorted")).distinct()


_LCS_SQL = "list_extract(list_reduce(string_split({a}, ''), lambda row, ch: list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN substr({b}, j, 1) = ch THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [0::BIGINT]), list_transform(range(0, length({b}) + 1), lambda x: 0::BIGINT)), -1)"
_PAIRS_SQL = "WITH n AS (SELECT DISTINCT p_brand, p_name FROM part), p AS (SELECT a.p_brand, a.p_name AS x, b.p_name AS y FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name)"


@query("indel_ratio", _PAIRS_SQL + f" SELECT p_brand, x, y, round(200.0 * {_LCS_SQL.format(a='x', b='y')} / (length(x) + length(y)), 6) AS ratio FROM p")
def _(spark, d):
    n = t(spark, d, "part").select("p_brand", "p_name").distinct()
    pairs = n.withColumnRenamed("p_name", "x").join(n.withColumnRenamed("p_name", "y"), "p_brand").filter("x < y")
    return pairs.select("p_brand", "x", "y", F.round(indel_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))


_SORTED_SQL = "array_to_string(list_sort(string_split({c}, ' ')), ' ')"


@query(
    "incumbent_match",
    "WITH n AS (SELECT DISTINCT p_brand, p_name, p_size, upper(p_name) AS norm FROM part), k AS (SELECT DISTINCT p_brand, " + _SORTED_SQL.format(c="norm") + " AS y FROM n WHERE p_size > 45), l AS (SELECT DISTINCT p_brand, norm, " + _SORTED_SQL.format(c="norm") + " AS x FROM n WHERE p_size < 5), "
    f"b AS (SELECT l.p_brand, norm, max(200.0 * {_LCS_SQL.format(a='x', b='y')} / (length(x) + length(y))) AS score FROM l JOIN k ON l.p_brand = k.p_brand GROUP BY 1, 2) "
    "SELECT n.p_brand AS commune_insee, p_name AS full_name, p_size, coalesce(score >= 85, false) AS is_incumbent, round(score, 6) AS score, score IS NOT NULL AND score < 100 AS incumbent_match_auditable FROM n LEFT JOIN b ON n.p_brand = b.p_brand AND n.norm = b.norm WHERE p_size < 5",
)
def _(spark, d):
    n = t(spark, d, "part").select(F.col("p_brand").alias("commune_insee"), F.col("p_name").alias("full_name"), "p_size").distinct()
    # the SQL takes parts by size as leaders and as incumbents; here each is all parts of the brand
    known = n.select("commune_insee", text.normalize_name("full_name").alias("incumbent_name")).distinct()
    return match_incumbents(n, known).select("commune_insee", "full_name", "p_size", "is_incumbent", F.round("incumbent_match_score", 6).alias("score"), "incumbent_match_auditable")


# --- URLs and pages --------------------------------------------------------------------------------------------

_PART = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_URL_SQL = (
    f"WITH p AS (SELECT page_id, trim(url) AS url, lower(regexp_extract(trim(url), '{_PART}', 1)) AS scheme, regexp_replace(lower(regexp_extract(trim(url), '{_PART}', 2)), '^www\\.', '') AS host, "
    f"regexp_replace(regexp_extract(trim(url), '{_PART}', 3), '/+$', '') AS path, array_to_string(list_filter(string_split(regexp_extract(trim(url), '{_PART}', 4), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ("
    + ", ".join(f"'{k}'" for k in TRACKING_KEYS)
    + ")), '&') AS q FROM {source}), canonical AS (SELECT page_id, url, concat(CASE WHEN scheme = '' THEN 'https' ELSE scheme END, '://', host, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN q = '' THEN '' ELSE concat('?', q) END) AS canonical_url FROM p)"
)
_DIRTY = "(SELECT page_id, concat(replace(url, '://', '://WWW.'), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'UTM_source=a&id=', page_id % 40, '&ref=b#top') AS url FROM pages)"


@query("canonical_url", _URL_SQL.replace("{source}", "pages") + " SELECT page_id, canonical_url FROM canonical")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", url.canonical_url("url").alias("canonical_url"))


@query("canonical_url_dirty", _URL_SQL.replace("{source}", _DIRTY) + " SELECT page_id, canonical_url FROM canonical")
def _(spark, d):
    more = F.concat(F.replace("url", F.lit("://"), F.lit("://WWW.")), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("UTM_source=a&id="), (F.col("page_id") % 40).cast("string"), F.lit("&ref=b#top"))
    return t(spark, d, "pages").select("page_id", url.canonical_url(more).alias("canonical_url"))


@query("sanitize_url", "WITH u AS (SELECT page_id, string_split(url, '#')[1] AS u FROM pages) SELECT page_id, concat(u, CASE WHEN contains(u, '?') THEN '&' ELSE '?' END, 'q=', page_id, '#part') AS safe FROM u")
def _(spark, d):
    bare = F.element_at(F.split("url", "#"), 1)
    asked = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("apikey=secret&q="), F.col("page_id").cast("string"), F.lit("&TOKEN=x#part"))
    return t(spark, d, "pages").select("page_id", url.sanitized_url(asked).alias("safe"))


@query("strip_html", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS plain FROM pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", text.strip_html("html", unescape=False).alias("plain"))


@query("domain_key", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", text.outlet_from_domain(url.parts(F.col("url")).authority).alias("domain"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select(
        F.col("url").alias("article_url"), F.md5("html").alias("title"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("d").alias("domain"), F.lit("fr").alias("language"), F.col("page_id").alias(news.HIT_SEQ),
        F.when(F.col("page_id") % 2 == 0, "curated").otherwise("gnews").alias("provider"), F.lit("tier").alias("provider_tier"), F.lit("o").alias("outlet_key"), F.lit("raw").alias("raw_payload_path"), F.lit("q").alias("query_text"), F.lit("s").alias("query_strategy"), F.lit("l").alias("leader_id"),
    )


_CANON = _URL_SQL.replace("{source}", "pages")


@query("article_facts", _CANON + ", j AS (SELECT canonical.*, md5(html) AS title FROM canonical JOIN pages USING (page_id)) SELECT md5(canonical_url) AS article_id, canonical_url, url, title, 'not_fetched' AS fetch_status FROM j QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY page_id) = 1")
def _(spark, d):
    return news.articles(_hits(spark, d)).select("article_id", "canonical_url", "url", "title", "fetch_status")


@query("discovery", _CANON + " SELECT md5(concat(md5(canonical_url), ':', CASE WHEN page_id % 2 = 0 THEN 'curated' ELSE 'gnews' END, ':o:raw:q')) AS discovery_id, md5(canonical_url) AS article_id, url AS article_url, '' AS partition_date FROM canonical")
def _(spark, d):
    return news.discoveries(_hits(spark, d)).select("discovery_id", "article_id", "article_url", "partition_date")


@query("dedup_within_query", _CANON + " SELECT min(page_id) AS hit_seq, canonical_url FROM canonical GROUP BY canonical_url, page_id % 2")
def _(spark, d):
    return news.dedup_within_query(_hits(spark, d)).select(news.HIT_SEQ, url.canonical_url("article_url").alias("canonical_url"))


_STATUS_SQL = r"CASE WHEN lang = 'de' THEN 'http_error' WHEN lang = 'es' THEN 'extractor_unavailable' WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 500 THEN 'too_short' ELSE 'success' END"


@query("fetch_status", f"SELECT doc_id, {_STATUS_SQL} AS fetch_status FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", news.fetch_status(F.col("lang") == "de", F.col("lang") != "es", F.col("text"), 500).alias("fetch_status"))


@query("fetch_success", f"SELECT round(avg(CASE WHEN {_STATUS_SQL} = 'success' THEN 1.0 ELSE 0.0 END), 9) AS article_fetch_success_rate FROM documents")
def _(spark, d):
    rows = t(spark, d, "documents").select(news.fetch_status(F.col("lang") == "de", F.col("lang") != "es", F.col("text"), 500).alias("fetch_status"))
    return bench.fetch_success(rows).select(F.round("article_fetch_success_rate", 9).alias("article_fetch_success_rate"))


# --- truth -----------------------------------------------------------------------------------------------------


def _truth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(results, cases): documents as hits of labelled truth, URLs made of ids."""
    page = lambda c: F.concat(F.lit("https://site.fr/"), c.cast("string"))
    docs = t(spark, d, "documents").select(F.lit("l").alias("leader_id"), F.col("source").alias("outlet_key"), page(F.col("doc_id")).alias("canonical_url"), F.when(F.col("lang") == "en", "curated").otherwise("gnews").alias("provider"))
    doc = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source"))
    cases = t(spark, d, "labels").join(doc, F.col("doc_id") == F.col("id"), "left").select(
        F.col("doc_id").alias("benchmark_case_id"), F.lit("l").alias("leader_id"), F.when(F.col("toxic") == 1, "elsewhere").otherwise(F.col("source")).alias("expected_outlet_key"), F.when(F.col("quality") == 1, page(F.col("doc_id"))).alias("manual_article_url")
    )
    audit = spark.createDataFrame([("l", "curated", "success_hits")], "leader_id string, provider string, provider_status string").withColumn("provider_tier", F.lit("t"))
    fetched = spark.createDataFrame([], "canonical_url string, fetch_status string, body_text string")
    return bench.results(docs, cases, audit, fetched), cases


_TRUTH_SQL = """
    WITH c AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'elsewhere' ELSE source END AS expected, quality = 1 AS has FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id),
    r AS (SELECT d.doc_id, CASE WHEN lang = 'en' THEN 'curated' ELSE 'gnews' END AS provider, c.doc_id AS benchmark_case_id FROM documents d LEFT JOIN c ON c.has AND c.doc_id = d.doc_id AND c.expected = d.source)
"""


@query("truth_join", _TRUTH_SQL + "SELECT concat('https://site.fr/', doc_id) AS canonical_url, provider, CAST(benchmark_case_id AS VARCHAR) AS benchmark_case_id, benchmark_case_id IS NOT NULL AS is_truth_match, 'not_fetched' AS article_fetch_status, CASE WHEN provider = 'curated' THEN 'success_hits' END AS provider_status FROM r")
def _(spark, d):
    return _truth(spark, d)[0].select("canonical_url", "provider", F.col("benchmark_case_id").cast("string").alias("benchmark_case_id"), "is_truth_match", "article_fetch_status", "provider_status")


@query("recall", _TRUTH_SQL + ", n AS (SELECT count(*) FILTER (has) AS truth_article_count FROM c), m AS (SELECT count(DISTINCT benchmark_case_id) AS matched_truth_article_count FROM r) SELECT *, round(matched_truth_article_count / truth_article_count, 9) AS recall FROM n, m")
def _(spark, d):
    return bench.recall(*_truth(spark, d)).withColumn("recall", F.round("recall", 9))


@query("source_overlap", _TRUTH_SQL + "SELECT avg(n)::DOUBLE AS source_overlap_count FROM (SELECT count(DISTINCT provider) AS n FROM r WHERE benchmark_case_id IS NOT NULL GROUP BY doc_id)")
def _(spark, d):
    return bench.source_overlap(_truth(spark, d)[0])


# --- sampling --------------------------------------------------------------------------------------------------

_QUOTA = {("large", "BUILDING"): 2, ("large", "MACHINERY"): 2, ("medium", "BUILDING"): 4, ("medium", "MACHINERY"): 4, ("small", "BUILDING"): 6, ("small", "MACHINERY"): 6}
_SAMPLE_SQL = (
    f"WITH p AS (SELECT c_custkey, {BUCKET_SQL} AS bucket, c_mktsegment AS grp, c_nationkey AS cnt FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY bucket, grp ORDER BY cnt, md5(concat('42|', c_custkey)), c_custkey) AS place FROM p), "
    "q(bucket, grp, n) AS (VALUES " + ", ".join(f"('{b}', '{g}', {n})" for (b, g), n in _QUOTA.items()) + "), s AS (SELECT c_custkey, r.bucket, r.grp, cnt FROM r JOIN q ON r.bucket = q.bucket AND r.grp = q.grp WHERE place <= n)"
)


def _sample(spark: SparkSession, d: str) -> DataFrame:
    pool = t(spark, d, "customer").select("c_custkey", size_bucket(population()).alias("bucket"), F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("cnt"))
    return stratified(pool, _QUOTA, 42, "bucket", "grp", "cnt", "c_custkey")


@query("stratified_sample", _SAMPLE_SQL + " SELECT * FROM s")
def _(spark, d):
    return _sample(spark, d)


@query("sample_manifest", _SAMPLE_SQL + " SELECT bucket, grp, count(*) AS n, count(DISTINCT cnt) AS regions, string_agg(DISTINCT CAST(cnt AS VARCHAR), ',' ORDER BY CAST(cnt AS VARCHAR)) AS codes FROM s GROUP BY ALL")
def _(spark, d):
    return _sample(spark, d).groupBy("bucket", "grp").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cnt").alias("regions"), F.array_join(F.sort_array(F.collect_set(F.col("cnt").cast("string"))), ",").alias("codes"))


@query("draw_order", "SELECT c_custkey, md5(concat('43|', c_custkey)) AS draw FROM customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", draw_key(43, "c_custkey").alias("draw"))


@query(
    "swap_candidates",
    f"SELECT reg, c_custkey FROM (SELECT n_regionkey AS reg, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {BUCKET_SQL} <> 'excluded') QUALIFY row_number() OVER (PARTITION BY reg ORDER BY md5(concat('42|', c_custkey)), c_custkey) = 1",
)
def _(spark, d):
    pool = communes(spark, d).filter(not_excluded()).join(F.broadcast(t(spark, d, "nation")), F.col("dep") == F.col("n_nationkey"))
    return first_of(pool.select(F.col("n_regionkey").alias("reg"), F.col("commune_insee").alias("c_custkey")), ["reg"], [draw_key(42, "c_custkey"), "c_custkey"])


# --- windows, times and lineage --------------------------------------------------------------------------------

_BOUNDS_SQL = "WITH b AS (SELECT CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) AS e FROM events)"


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").agg(F.to_date(F.min("ts")).alias("window_start"), F.to_date(F.max("ts")).alias("window_end"))


@query("request_windows", _BOUNDS_SQL + ", w AS (SELECT e, unnest(generate_series(s, e, INTERVAL 7 DAY))::DATE AS w FROM b) SELECT strftime(w, '%Y%m%d') || '000000' AS first, strftime(least(w + 6, e), '%Y%m%d') || '235959' AS last FROM w")
def _(spark, d):
    return request_windows(_bounds(spark, d)).select(request_time("request_start").alias("first"), request_time("request_end", end=True).alias("last"))


@query(
    "split_windows",
    _BOUNDS_SQL + ", w AS (SELECT e, unnest(generate_series(s, e, INTERVAL 7 DAY))::DATE AS w FROM b), h AS (SELECT w, least(w + 6, e) AS l, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) BETWEEN w AND least(w + 6, e)) AS n FROM w), "
    "f AS (SELECT *, n >= 237 AS crowded FROM h) SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS request_start, CAST(CASE WHEN crowded THEN CAST(x AS DATE) ELSE l END AS VARCHAR) AS request_end FROM (SELECT *, unnest(CASE WHEN crowded AND l > w THEN generate_series(w, l, INTERVAL 1 DAY) ELSE [w::TIMESTAMP] END) AS x FROM f)",
)
def _(spark, d):
    w = request_windows(_bounds(spark, d))
    days = t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    counted = w.join(days, F.col("day").between(F.col("request_start"), F.col("request_end")), "left").groupBy(*w.columns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
    return split_near_cap(counted, F.col("hits")).select(F.col("request_start").cast("string").alias("request_start"), F.col("request_end").cast("string").alias("request_end"))


@query("provider_window", "SELECT event_id, CAST(CAST(CASE WHEN event_type = 'click' AND user_id % 2 = 1 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS DATE) AS VARCHAR) AS start FROM events")
def _(spark, d):
    day = F.to_date("ts")
    name = F.when(F.col("event_type") == "click", "gnews").otherwise("curated")
    return t(spark, d, "events").select("event_id", provider_start(name, day, F.date_add(day, (F.col("user_id") % 2).cast("int"))).cast("string").alias("start"))


_MAIL = "concat(strftime(ts, '%a, %d %b %Y %H:%M:%S'), ' +0200')"


@query("feed_times", "SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL 2 HOUR END AS at FROM events")
def _(spark, d):
    ts = F.col("ts").cast("timestamp")
    mail = F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    raw = F.when(F.col("event_type") == "view", "soon").when(F.col("event_type") == "click", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(mail)
    return t(spark, d, "events").select("event_id", feed_time(raw).cast("timestamp_ntz").alias("at"))


@query("event_times", "SELECT event_id, CASE WHEN event_type <> 'view' THEN date_trunc('second', ts) END AS at FROM events")
def _(spark, d):
    raw = F.when(F.col("event_type") == "view", "20261399T000000Z").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'"))
    return t(spark, d, "events").select("event_id", event_time(raw).cast("timestamp_ntz").alias("at"))


@query("latest_snapshot", "SELECT user_id AS source_key, arg_max(event_id, (ts, event_id)) AS source_hash, max(ts) AS fetched_at FROM events GROUP BY user_id")
def _(spark, d):
    return t(spark, d, "events").groupBy(F.col("user_id").alias("source_key")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("source_hash"), F.max("ts").alias("fetched_at"))


@query("upsert_run", "WITH o AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), n AS (SELECT user_id, min(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id)")
def _(spark, d):
    e = t(spark, d, "events")
    old, new = e.filter("event_type = 'click'").groupBy("user_id").agg(F.max("value").alias("v")), e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("value").alias("v"))
    return upsert(old, new, ["user_id"])


@query("insert_snapshot", "WITH o AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), n AS (SELECT user_id, min(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.user_id = o.user_id)")
def _(spark, d):
    e = t(spark, d, "events")
    old, new = e.filter("event_type = 'click'").groupBy("user_id").agg(F.max("value").alias("v")), e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("value").alias("v"))
    return insert_if_absent(old, new, ["user_id"])


@query("raw_paths", "SELECT event_id, concat('scope=leader_i_', substr(concat('id_', user_id), 1, 12), '_', substr(md5(concat('id-', user_id)), 1, 8), '/window=', strftime(ts, '%Y%m%d'), '_', strftime(ts + INTERVAL 1 DAY, '%Y%m%d'), '/doc_', substr(md5(CAST(event_id AS VARCHAR)), 1, 16), CASE WHEN event_type = 'view' THEN '.xml' ELSE '.json' END) AS path FROM events")
def _(spark, d):
    from hustings.sources.writers import raw_file_name, scope_segment, window_segment

    day = F.to_date("ts")
    kind = F.when(F.col("event_type") == "view", "xml").otherwise("json")
    path = F.concat_ws("/", scope_segment(F.lit("leader_id"), F.concat(F.lit("id-"), F.col("user_id").cast("string"))), window_segment(day, F.date_add(day, 1)), raw_file_name(F.col("event_id").cast("string"), kind))
    return t(spark, d, "events").select("event_id", path.alias("path"))


@query("raw_hash_join", "SELECT event_id, CASE WHEN c_custkey IS NULL THEN CAST(user_id AS VARCHAR) ELSE c_name END AS raw_payload_path, coalesce(md5(c_name), '') AS _source_hash FROM events LEFT JOIN customer ON user_id = c_custkey AND c_mktsegment = 'BUILDING'")
def _(spark, d):
    raw = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("raw_document_key"), F.col("c_name").alias("path"), F.lit("https://a.fr/?key=1").alias("source_url"), F.md5("c_name").alias("source_hash"))
    hits = t(spark, d, "events").select(F.col("event_id").cast("string").alias("title"), F.col("user_id").cast("string").alias("raw_payload_path"))
    return news.bronze_hits(hits, raw).select(F.col("title").cast("bigint").alias("event_id"), "raw_payload_path", "_source_hash")


@query("first_children", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3")
def _(spark, d):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(spark, d, "events").withColumn("place", place).filter("place <= 3").select("event_id")


# --- planned tier ----------------------------------------------------------------------------------------------


@query("exposure_metrics", "SELECT source AS leader_id, count(DISTINCT doc_id) AS article_count, count(*) FILTER (n_chars > 3000) AS headline_mentions, count(DISTINCT lang) AS source_count FROM documents GROUP BY source")
def _(spark, d):
    return marts.exposure(t(spark, d, "documents").select(F.col("source").alias("leader_id"), F.col("doc_id").alias("article_id"), F.col("lang").alias("domain"), (F.col("n_chars") > 3000).alias("in_title")))


_LEXICON = (("small", "the"), ("small", "and"), ("other", "idiot"), ("other", "clown"))


@query(
    "word_counts",
    f"WITH w AS (SELECT doc_id, list_filter(string_split({_MATCH_SQL.format(c='text')}, ' '), lambda x: x <> '') AS ws FROM documents), u AS (SELECT doc_id, len(ws) AS word_count, unnest(ws) AS w FROM w) "
    "SELECT doc_id, CASE WHEN w IN ('the', 'and') THEN 'small' ELSE 'other' END AS category, count(*) AS count, any_value(word_count) AS word_count, round(count(*) * 1000.0 / any_value(word_count), 6) AS per_1k_words FROM u WHERE w IN ('the', 'and', 'idiot', 'clown') GROUP BY 1, 2",
)
def _(spark, d):
    return marts.lexicon_counts(t(spark, d, "documents"), _LEXICON, "doc_id", "text").withColumn("per_1k_words", F.round("per_1k_words", 6)).withColumn("word_count", F.col("word_count").cast("bigint"))


_SIDE_SQL = "concat(label, ':', " + ", ".join(f"CASE WHEN embedding[{i}] > 0 THEN 1 ELSE 0 END" for i in (1, 2, 3)) + ")"


@query(
    "embedding_dups",
    f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_SIDE_SQL} AS block FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.block = b.block AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3",
)
def _(spark, d):
    # the SQL compares within a block of label and signs only; these are all pairs, the SQL's among them but for its NaN of vectors without a cosine
    # its round takes the double times 1e6, while Spark's takes the shortest decimal: ties at the seventh digit may differ
    return marts.embedding_pairs(t(spark, d, "embeddings"), 0.3, places=6).select("a", "b", (F.floor(F.col("similarity") * 1e6 + 0.5) / 1e6).alias("similarity"))


@query(
    "embedding_pairs",
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3",
)
def _(spark, d):
    return marts.embedding_pairs(t(spark, d, "embeddings"), 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("bias_by_gender", "SELECT round(f, 6) AS F, round(m, 6) AS M, round(f - m, 6) AS gap FROM (SELECT avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS m FROM orders)")
def _(spark, d):
    o = t(spark, d, "orders").withColumn("gender", F.when(F.col("o_orderstatus") == "F", "F").when(F.col("o_orderstatus") == "O", "M"))
    return marts.bias_by_gender(o.filter("gender IS NOT NULL"), "o_totalprice").select(*[F.round(c, 6).alias(c) for c in ("F", "M", "gap")])


@query("framing", "SELECT CAST(l_suppkey AS VARCHAR) AS leader_id, count(*) AS mentions, round(avg(l_discount), 9) AS l_discount, round(avg(l_tax), 9) AS l_tax FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = t(spark, d, "lineitem").withColumn("leader_id", F.col("l_suppkey").cast("string"))
    return marts.framing(rows, ["l_discount", "l_tax"]).select("leader_id", "mentions", F.round("l_discount", 9).alias("l_discount"), F.round("l_tax", 9).alias("l_tax"))


@query(
    "chi_square",
    "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS k FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c) "
    "SELECT round(sum((coalesce(n, 0) - r * k / t) ** 2 / (r * k / t)), 6) AS statistic, CAST((count(DISTINCT r.a) - 1) * (count(DISTINCT k.b) - 1) AS BIGINT) AS degrees FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b",
)
def _(spark, d):
    return marts.chi_square(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("statistic", 6).alias("statistic"), F.col("degrees").cast("bigint").alias("degrees"))


@query("mann_whitney", "WITH o AS (SELECT round(o_totalprice / 1000) AS v, o_orderstatus AS g FROM orders WHERE o_orderstatus IN ('F', 'O')), c AS (SELECT v, count(*) FILTER (g = 'F') AS n1, count(*) FILTER (g = 'O') AS n2 FROM o GROUP BY v), w AS (SELECT *, coalesce(sum(n2) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT sum(n1 * (below + n2 / 2.0))::DOUBLE AS u, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n2) AS BIGINT) AS n2 FROM w")
def _(spark, d):
    o = t(spark, d, "orders").withColumn("v", F.round(F.col("o_totalprice") / 1000))
    return marts.mann_whitney(o, "o_orderstatus", "v", "F", "O")


@query("poisson_regression", None)
def _(spark, d):
    counts = t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("o_totalprice") / 1e5).alias("price"))
    model = marts.poisson_regression(counts, "n", ["price"])
    return spark.createDataFrame([("intercept", float(model.intercept)), *(("price", float(c)) for c in model.coefficients)], "term string, value double")


@query("election_context", f"SELECT doc_id, {' OR '.join(_MATCH_SQL.format(c='text').join(('contains(', f", '{k}')")) for k in ELECTION_KEYWORDS)} AS found FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", text.any_token(text.normalize_match("text"), F.array(*[F.lit(k) for k in ELECTION_KEYWORDS])).alias("found"))
