"""Table contracts: fixed columns and types, and projections onto them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# Columns and order that readers of these tables rely on.
DIM_COMMUNE = "commune_insee string, commune_name string, dep_code string, reg_code string, seats_municipal bigint, seats_epci bigint, population bigint, city_size_bucket string"
DIM_LEADER = (
    "leader_id string, full_name string, gender string, commune_insee string, reg_code string, city_size_bucket string, same_name_candidate_count bigint, "
    "list_nuance string, nuance_group string, is_incumbent boolean, incumbent_match_score double, incumbent_match_auditable boolean, advanced_to_tour2 boolean"
)
SAMPLE_LEADERS = DIM_LEADER + ", commune_name string, dep_code string"
CANDIDATE_CASE = "leader_id string, full_name string, commune_name string, dep_code string, city_size_bucket string, window_start date, window_end date"
SEARCH_HIT = (
    "provider string, provider_tier string, outlet_key string, article_url string, title string, published_at timestamp, domain string, language string, raw_payload_path string, "
    "query_text string, query_strategy string, leader_id string, full_name string, commune_name string, dep_code string, city_size_bucket string"
)
BRONZE_HITS = SEARCH_HIT + ", window_start string, window_end string, _query_status string, _error_type string, _source_url string, _ingested_at string, _source_hash string"
QUERY_AUDIT = (
    "provider string, provider_tier string, leader_id string, full_name string, commune_name string, dep_code string, city_size_bucket string, window_start string, window_end string, "
    "provider_status string, provider_error_type string, provider_warning_count bigint, provider_hit_count bigint, request_url string, _ingested_at string"
)
FACT_ARTICLE = (
    "article_id string, url string, canonical_url string, title string, body_text string, published_at timestamp, domain string, language string, fetch_status string, "
    "is_duplicate boolean, canonical_article_id string, partition_date string"
)
DISCOVERY = (
    "discovery_id string, article_id string, leader_id string, provider string, provider_tier string, outlet_key string, article_url string, canonical_url string, title string, "
    "published_at timestamp, domain string, language string, raw_payload_path string, query_text string, query_strategy string, partition_date string"
)
TRUTH_CASE = "benchmark_case_id string, leader_id string, expected_outlet_key string, manual_article_url string, manual_title string, manual_published_at date"
OUTLET_DIAGNOSTIC = (
    "leader_id string, full_name string, commune_name string, provider string, provider_tier string, outlet_key string, display_name string, connector_capability string, outlet_status string, "
    "documents_fetched bigint, documents_parsed bigint, entry_count bigint, window_entry_count bigint, hit_count bigint, warning_count bigint, error_types array<string>, request_urls array<string>"
)
META_SNAPSHOT = "snapshot_id string, source_key string, source_url string, source_hash string, file_path string, row_count bigint, fetched_at timestamp"
META_RUN = "run_id string, flow_name string, start_ts timestamp, end_ts timestamp, status string, rows_ingested bigint, error_count bigint, artifact_paths string"
FEED_ENTRY = "outlet_key string, document_key string, entry_seq int, title string, link string, published_at timestamp"


def rename(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """New names for the columns that the map has; all others stay."""
    return df.withColumnsRenamed({k: v for k, v in columns.items() if k in df.columns})


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The contract's columns in order, missing ones as null, types as they should be (text that isn't a number: null)."""
    out = []
    for f in schema(ddl):
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif df.schema[f.name].dataType == f.dataType:
            out.append(F.col(f"`{f.name}`"))
        elif isinstance(df.schema[f.name].dataType, T.StringType) and isinstance(f.dataType, T.LongType):
            out.append(F.col(f"`{f.name}`").try_cast("double").try_cast("bigint").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name))
    return df.select(out)


def empty(spark, ddl: str) -> DataFrame:
    return spark.createDataFrame([], schema(ddl))
