"""Dimensions: communes, and list leaders with their incumbency and second round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.config import CANDIDATE_COLUMNS, COG_COLUMNS, DEFAULTS, INCUMBENT_COLUMNS, SEATS_COLUMNS, Settings
from hustings.functions.keys import leader_key
from hustings.functions.similarity import indel_ratio, sort_tokens
from hustings.functions.text import full_name, normalize_name, nuance_bloc, strip
from hustings.operators.contracts import DIM_COMMUNE, DIM_LEADER, conform, rename
from hustings.operators.errors import DataQualityError
from hustings.operators.quality import REASON, Split, membership, null_gate, require_unique, split, tag

SEQ = "_row_seq"


def with_order(df: DataFrame) -> DataFrame:
    """Rows numbered in the order of the file; kept where the source has numbered them."""
    return df if SEQ in df.columns else df.withColumn(SEQ, F.monotonically_increasing_id())


def size_bucket(population: Column, s: Settings = DEFAULTS) -> Column:
    """large, medium, small or excluded; unknown and non-positive populations are excluded."""
    n = population.try_cast("double").try_cast("bigint")
    return (
        F.when(n.isNull() | (n <= 0), "excluded").when(n >= s.city_size_large, "large").when(n >= s.city_size_medium, "medium").when(n >= s.city_size_small, "small").otherwise("excluded")
    )


def not_excluded(bucket: Column | str = "city_size_bucket") -> Column:
    """All but excluded ones; a row without bucket stays, for quarantine to name it."""
    return ~(F.col(bucket) if isinstance(bucket, str) else bucket).eqNullSafe("excluded")


def commune_dim(cog: DataFrame, seats: DataFrame, s: Settings = DEFAULTS) -> Split:
    """Communes with seats and population. Seats that come twice give a commune twice, and quarantine takes the later one."""
    cog = with_order(rename(cog, COG_COLUMNS))
    if "typecom" in cog.columns:
        cog = cog.filter(F.col("typecom") == "COM")
    seats = rename(seats, SEATS_COLUMNS)
    if "commune_insee" not in seats.columns:
        raise DataQualityError("seats join failed: no column commune_insee")
    if "commune_insee" not in cog.columns:
        raise DataQualityError("communes lack the column commune_insee")
    extra = [c for c in ("population", "seats_municipal", "seats_epci") if c in seats.columns]
    own = [c for c in ("commune_insee", "commune_name", "dep_code", "reg_code", SEQ) if c in cog.columns]
    seats = with_order(seats).select("commune_insee", *extra, F.col(SEQ).alias("_seat_seq"))
    joined = cog.select(*own).join(seats, "commune_insee", "left")
    population = F.col("population") if "population" in extra else F.lit(None).cast("string")
    joined = joined.withColumn("population", population.try_cast("double").try_cast("bigint")).withColumn("city_size_bucket", size_bucket(F.col("population"), s))
    shaped = conform(joined, DIM_COMMUNE + f", {SEQ} bigint, _seat_seq bigint")
    null_gate(shaped, ["commune_insee"], s.dq_max_null_rate, "dim_commune")
    checks = [(F.col("commune_insee").isNull(), "commune_insee is null")]
    tagged = tag(shaped, checks, "commune_insee", [SEQ, F.col("_seat_seq").asc_nulls_last()], "duplicate commune_insee")
    known = F.col("city_size_bucket").isin("large", "medium", "small", "excluded")
    tagged = tagged.withColumn(REASON, F.when(F.col(REASON).isNull() & ~F.coalesce(known, F.lit(False)), "invalid city_size_bucket").otherwise(F.col(REASON)))
    return split(tagged.drop(SEQ, "_seat_seq"))


def leaders_only(df: DataFrame) -> DataFrame:
    """List leaders: by the flag, else by the first place on the list, else all rows."""
    if "is_list_leader" in df.columns:
        return df.filter(F.lower(strip(F.col("is_list_leader"))) == "oui")
    if "position_on_list" in df.columns:
        return df.filter(strip(F.col("position_on_list")) == "1")
    return df


def with_full_name(df: DataFrame) -> DataFrame:
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    if "full_name" in df.columns:
        return df
    return df.withColumn("full_name", full_name(has("family_name"), has("given_name")))


def collision_counts(df: DataFrame, name: str = "full_name", count: str = "same_name_candidate_count") -> DataFrame:
    """How many rows share the normalised name; null where the name is empty."""
    named = df.withColumn("_norm", F.nullif(normalize_name(name), F.lit("")))
    # counted before they meet, so rows of one very common name never stand in one task; empty names meet nowhere
    counts = named.filter("_norm IS NOT NULL").groupBy(F.col("_norm").alias("_counted")).agg(F.count(F.lit(1)).alias(count))
    return named.drop(count).join(counts, F.col("_norm") == F.col("_counted"), "left").drop("_norm", "_counted")


def incumbents(df: DataFrame) -> DataFrame:
    """(commune_insee, incumbent_name): normalised names of incumbents, blank ones left out."""
    df = with_full_name(rename(df, INCUMBENT_COLUMNS))
    return df.select("commune_insee", normalize_name("full_name").alias("incumbent_name")).filter("incumbent_name <> '' AND commune_insee IS NOT NULL").distinct()


def match_incumbents(leaders: DataFrame, lookup: DataFrame, threshold: float = DEFAULTS.incumbent_match_threshold) -> DataFrame:
    """is_incumbent, incumbent_match_score and incumbent_match_auditable of each leader.

    Only incumbents of the leader's commune are compared. No such incumbent: false and no score; a blank name or
    commune: null and no score. The best score decides. Only equal names reach 100, the most there is, so a leader
    whose sorted words are an incumbent's has it at once, and only the others are compared, with every incumbent.
    """
    named = leaders.withColumn("_norm", normalize_name("full_name"))
    blank = (F.col("_norm") == "") | (strip(F.coalesce("commune_insee", F.lit(""))) == "")
    asked = named.filter(~blank).select("commune_insee", "_norm", sort_tokens(F.col("_norm")).alias("_words")).distinct()
    known = lookup.select("commune_insee", sort_tokens(F.col("incumbent_name")).alias("_known")).distinct()
    equal = (F.col("commune_insee") == F.col("_commune")) & (F.col("_words") == F.col("_known"))
    twins = known.withColumnRenamed("commune_insee", "_commune")
    same = asked.join(twins, equal, "left_semi").select("commune_insee", "_norm", F.lit(100.0).alias("incumbent_match_score"))
    others = asked.join(twins, equal, "left_anti").join(known, "commune_insee").withColumn("score", indel_ratio(F.col("_words"), F.col("_known")))
    best = same.unionByName(others.groupBy("commune_insee", "_norm").agg(F.max("score").alias("incumbent_match_score")))
    score = F.col("incumbent_match_score")
    return (
        named.drop("incumbent_match_score").join(best, ["commune_insee", "_norm"], "left")
        .withColumn("is_incumbent", F.when(blank, F.lit(None).cast("boolean")).otherwise(F.coalesce(score >= threshold, F.lit(False))))
        .withColumn("incumbent_match_auditable", score.isNotNull() & (score < 100)).drop("_norm")
    )


def second_round(leaders: DataFrame, tour2: DataFrame | None) -> DataFrame:
    """advanced_to_tour2: whether the leader's commune and normalised name are in the second round; null without one."""
    if tour2 is None:
        return leaders.withColumn("advanced_to_tour2", F.lit(None).cast("boolean"))
    keys = with_full_name(leaders_only(rename(tour2, CANDIDATE_COLUMNS))).select("commune_insee", normalize_name("full_name").alias("_norm")).filter("_norm <> ''").distinct()
    known = keys.withColumn("_in", F.lit(True))
    # one row that tells whether there is a second round at all
    some = keys.limit(1).agg(F.count(F.lit(1)).alias("_some"))
    return (
        leaders.withColumn("_norm", normalize_name("full_name")).join(known, ["commune_insee", "_norm"], "left").join(F.broadcast(some))
        .withColumn("advanced_to_tour2", F.when((F.col("_some") > 0) & (F.col("_norm") != ""), F.coalesce("_in", F.lit(False)))).drop("_norm", "_in", "_some")
    )


def leader_dim(candidates: DataFrame, communes: DataFrame, incumbent_rows: DataFrame | None = None, tour2: DataFrame | None = None, s: Settings = DEFAULTS) -> Split:
    """List leaders of communes that are not excluded. Names are counted over all candidates, leaders or not."""
    rows = with_full_name(with_order(rename(candidates, CANDIDATE_COLUMNS)))
    if "commune_insee" not in rows.columns or "commune_insee" not in communes.columns:
        raise DataQualityError("leaders and communes both need the column commune_insee")
    rows = leaders_only(collision_counts(rows))
    own = [c for c in ("full_name", "gender", "commune_insee", "list_nuance", "same_name_candidate_count", SEQ) if c in rows.columns]
    place = require_unique(communes.select("commune_insee", "reg_code", "city_size_bucket"), ["commune_insee"], "dim_commune")
    rows = rows.select(*own).join(place, "commune_insee", "left").filter(not_excluded())
    rows = rows.withColumn("nuance_group", nuance_bloc("list_nuance") if "list_nuance" in rows.columns else F.lit(None).cast("string"))
    if incumbent_rows is not None:
        rows = match_incumbents(rows, incumbents(incumbent_rows), s.incumbent_match_threshold)
    rows = second_round(rows, tour2).withColumn("leader_id", leader_key("full_name", "commune_insee"))
    shaped = conform(rows, DIM_LEADER + f", {SEQ} bigint").withColumn("incumbent_match_auditable", F.coalesce("incumbent_match_auditable", F.lit(False)))
    if "gender" in own:
        null_gate(shaped, ["gender"], s.dq_max_null_rate, "dim_candidate_leader")
    shaped = membership(shaped, communes, ["commune_insee"], "_known")
    checks = [
        (~F.coalesce(F.col("gender").isin("M", "F"), F.lit(False)), "gender not in {M, F}"),
        (~F.col("_known"), "commune_insee not in dim_commune"),
        (F.col("leader_id").isNull() | (F.length("leader_id") != 32), "invalid leader_id"),
    ]
    return split(tag(shaped, checks, "leader_id", [SEQ], "duplicate leader_id").drop(SEQ, "_known"))
