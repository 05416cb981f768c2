"""Discovery against manually found articles: the results table and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.functions.url import canonical_url
from hustings.operators.quality import require_unique

FOUND = ("success_hits", "success_zero")


def truth(cases: DataFrame) -> DataFrame:
    """The cases with the canonical URL of their article; null without one."""
    return cases.withColumn("truth_canonical_url", F.when(F.coalesce("manual_article_url", F.lit("")) != "", canonical_url("manual_article_url")))


def results(discovery: DataFrame, cases: DataFrame, audit: DataFrame, fetched: DataFrame) -> DataFrame:
    """Discoveries with their fetch status, the truth case they hit and their query's audit; rows never multiply."""
    t = require_unique(truth(cases).filter("truth_canonical_url IS NOT NULL"), ["leader_id", "expected_outlet_key", "truth_canonical_url"], "truth cases").withColumnRenamed("leader_id", "_leader")
    q = require_unique(audit.withColumnRenamed("provider_tier", "query_provider_tier"), ["leader_id", "provider"], "query audit").withColumnsRenamed({"leader_id": "_q_leader", "provider": "_q_provider"})
    q = q.drop(*[c for c in discovery.columns if c in q.columns])
    status = fetched.select(F.col("canonical_url").alias("_url"), F.col("fetch_status").alias("article_fetch_status")).dropDuplicates(["_url"])
    d = discovery.join(status, F.col("canonical_url") == F.col("_url"), "left").drop("_url").withColumn("article_fetch_status", F.coalesce("article_fetch_status", F.lit("not_fetched")))
    d = d.join(t, (F.col("leader_id") == F.col("_leader")) & (F.col("outlet_key") == F.col("expected_outlet_key")) & (F.col("canonical_url") == F.col("truth_canonical_url")), "left").drop("_leader")
    d = d.withColumn("is_truth_match", F.col("benchmark_case_id").isNotNull())
    return d.join(q, (F.col("leader_id") == F.col("_q_leader")) & (F.col("provider") == F.col("_q_provider")), "left").drop("_q_leader", "_q_provider")


def recall(result: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: truth cases with an article, articles found, and their share; null without truth."""
    have = cases.agg(F.count_if(F.coalesce("manual_article_url", F.lit("")) != "").alias("truth_article_count"))
    got = result.agg(F.count_distinct(F.when(F.col("is_truth_match"), F.col("truth_canonical_url"))).alias("matched_truth_article_count"))
    return have.join(F.broadcast(got)).withColumn("recall", F.col("matched_truth_article_count") / F.nullif(F.col("truth_article_count"), F.lit(0)))


def source_overlap(result: DataFrame) -> DataFrame:
    """One row: providers that found a matched article, on average; null without matches."""
    per_url = result.filter("is_truth_match").groupBy("truth_canonical_url").agg(F.count_distinct("provider").alias("n"))
    return per_url.agg(F.avg(F.col("n").cast("double")).alias("source_overlap_count"))


def availability(audit: DataFrame) -> DataFrame:
    """One row: share of queries that a provider answered; null without queries."""
    return audit.agg(F.avg(F.col("provider_status").isin(*FOUND).cast("double")).alias("provider_availability_rate"))


def fetch_success(fetched: DataFrame) -> DataFrame:
    """One row: share of distinct articles whose body was fetched; null without any."""
    return fetched.agg(F.avg((F.col("fetch_status") == "success").cast("double")).alias("article_fetch_success_rate"))


def summary(result: DataFrame, cases: DataFrame, audit: DataFrame, fetched: DataFrame, hits: DataFrame) -> DataFrame:
    """All metrics in one row."""
    from hustings.operators.news import duplicate_rate

    out = recall(result, cases)
    for one in (duplicate_rate(hits), fetch_success(fetched), source_overlap(result), availability(audit)):
        out = out.join(F.broadcast(one))
    return out
