"""Matched stratified sampling with a geographic swap."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.config import DEFAULTS, Settings
from hustings.operators.contracts import SAMPLE_LEADERS, conform
from hustings.operators.dims import not_excluded
from hustings.operators.errors import SamplingError
from hustings.operators.quality import require_columns, require_unique

GENDERS = ("F", "M")


def eligible(leaders: DataFrame) -> DataFrame:
    return leaders.filter(not_excluded() & F.coalesce(F.col("gender").isin(*GENDERS), F.lit(False)))


def draw_key(seed: int, id_column: str = "leader_id") -> Column:
    """A random order that the seed and the id alone decide, however rows are dealt."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")))


def quotas(s: Settings = DEFAULTS) -> dict[tuple[str, str], int]:
    """Rows of each (bucket, gender): half of the bucket's total each."""
    return {(b, g): n // 2 for b, n in s.quotas.items() for g in GENDERS}


def stratified(pool: DataFrame, wanted: Mapping[tuple[str, str], int], seed: int, bucket: str = "city_size_bucket", group: str = "gender", count: str = "same_name_candidate_count", id_column: str = "leader_id") -> DataFrame:
    """The first rows of each stratum up to its quota: fewest namesakes first, then by draw.

    A stratum's ranks come from a window with a limit on the rank, which Spark applies before the shuffle
    too, so a large stratum costs its quota, not its size.
    """
    quota = F.lit(0)
    for (b, g), n in sorted(wanted.items()):
        quota = F.when((F.col(bucket) == b) & (F.col(group) == g), n).otherwise(quota)
    place = F.row_number().over(Window.partitionBy(bucket, group).orderBy(F.col(count).asc_nulls_last(), draw_key(seed, id_column), id_column))
    top = max(wanted.values(), default=0)
    return pool.withColumn("_place", place).filter(F.col("_place") <= top).filter(F.col("_place") <= quota).drop("_place")


def check_pool(pool: DataFrame, wanted: Mapping[tuple[str, str], int]) -> None:
    """Fails for unknown name counts and for short strata, women before men."""
    require_columns(pool, ["same_name_candidate_count"], "the pool", SamplingError)
    rows = pool.groupBy("city_size_bucket", "gender").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("same_name_candidate_count").isNull()).alias("unknown")).collect()
    have = {(r[0], r[1]): r for r in rows}
    if any(r["unknown"] for r in rows):
        raise SamplingError("same_name_candidate_count holds nulls")
    for (b, g), n in wanted.items():
        got = have[b, g]["n"] if (b, g) in have else 0
        if got < n:
            raise SamplingError(f"Stratum '{b}': need {n} {'female' if g == 'F' else 'male'} candidates, found {got}")


def swap_regions(sample: list[dict], pool: DataFrame, seed: int, least: int) -> tuple[list[dict], list[str]]:
    """The sample with leaders of absent regions in place of ones of the most frequent region, and warnings.

    Runs only if the sample has fewer regions than ``least``; then every absent region is tried, in order of its
    code: its first unsampled leader by draw replaces a leader of the same gender and bucket. Ties between
    regions go to the smaller code. One window query gives a candidate for each region, so little is collected.
    """
    warnings: list[str] = []
    if len({r["reg_code"] for r in sample if r["reg_code"] is not None}) >= least:
        return sample, warnings
    sample = list(sample)
    taken = [r["leader_id"] for r in sample]
    present = {r["reg_code"] for r in sample}
    place = F.row_number().over(Window.partitionBy("reg_code").orderBy(draw_key(seed), "leader_id"))
    others = pool.filter(F.col("reg_code").isNotNull() & ~F.col("leader_id").isin(taken)).withColumn("_place", place).filter("_place = 1").drop("_place")
    for row in sorted((r.asDict() for r in others.collect()), key=lambda r: r["reg_code"]):
        if row["reg_code"] in present:
            continue
        counts = Counter(r["reg_code"] for r in sample if r["reg_code"] is not None)
        crowded = min(counts, key=lambda c: (-counts[c], c))
        out = next((r for r in sorted(sample, key=lambda r: r["leader_id"]) if r["reg_code"] == crowded and r["gender"] == row["gender"] and r["city_size_bucket"] == row["city_size_bucket"]), None)
        if out is None:
            warnings.append(f"no swap for region {row['reg_code']}")
            continue
        sample[sample.index(out)] = {k: row[k] for k in out}
        present.add(row["reg_code"])
    if len({r["reg_code"] for r in sample}) < least:
        warnings.append(f"fewer than {least} regions")
    return sample, warnings


def validate(sample: list[dict], s: Settings = DEFAULTS) -> list[str]:
    """Fails unless size, gender balance and ids are right; returns warnings."""
    total = sum(s.quotas.values())
    genders = Counter(r["gender"] for r in sample)
    if len(sample) != total:
        raise SamplingError(f"sample has {len(sample)} rows, expected {total}")
    if any(genders[g] != total // 2 for g in GENDERS):
        raise SamplingError(f"sample has {genders['F']} women and {genders['M']} men, expected {total // 2} each")
    if len({r["leader_id"] for r in sample}) != total:
        raise SamplingError("leader_id is not unique in the sample")
    regions = len({r["reg_code"] for r in sample if r["reg_code"] is not None})
    return [] if regions >= s.sample_min_region_count else [f"sample has {regions} regions, fewer than {s.sample_min_region_count}"]


def with_communes(sample: DataFrame, communes: DataFrame, columns: tuple[str, ...] = ("commune_name", "dep_code")) -> DataFrame:
    """The sample with columns of its communes; fails where one is unknown."""
    place = require_unique(communes.select("commune_insee", *columns), ["commune_insee"], "dim_commune")
    joined = sample.drop(*columns).join(place, "commune_insee", "left")
    lost = joined.filter(F.col(columns[0]).isNull()).count()
    if lost:
        raise SamplingError(f"{lost} sampled leaders have no {columns[0]} in dim_commune")
    return joined


def build_sample(leaders: DataFrame, communes: DataFrame, s: Settings = DEFAULTS, seed: int | None = None) -> tuple[DataFrame, list[str]]:
    """(sample_leaders, warnings): strata filled by quota, regions swapped in, all checked."""
    require_columns(leaders, ["leader_id", "gender", "city_size_bucket", "reg_code", "commune_insee", "same_name_candidate_count"], "leaders", SamplingError)
    require_columns(communes, ["commune_insee", "commune_name", "dep_code"], "communes", SamplingError)
    seed = s.sampling_random_seed if seed is None else seed
    pool, wanted = eligible(leaders), quotas(s)
    check_pool(pool, wanted)
    drawn = stratified(pool, wanted, seed)
    rows, warnings = swap_regions([r.asDict() for r in drawn.collect()], pool, seed, s.sample_min_region_count)
    warnings += validate(rows, s)
    sample = leaders.sparkSession.createDataFrame([tuple(r[c] for c in drawn.columns) for r in rows], drawn.schema)
    return conform(with_communes(sample, communes), SAMPLE_LEADERS), warnings


def manifest(sample: DataFrame, communes: DataFrame, run_id: str, created_at: str, seed: int) -> str:
    """The sample's description as JSON: counts, regions and the candidates."""
    rows = [r.asDict() for r in with_communes(sample, communes, ("population",)).collect()]
    count = lambda c: dict(sorted(Counter(r[c] for r in rows if r[c] is not None).items()))
    regions = sorted({r["reg_code"] for r in rows if r["reg_code"] is not None})
    keep = ("leader_id", "full_name", "gender", "commune_insee", "commune_name", "dep_code", "reg_code", "population", "city_size_bucket", "nuance_group", "is_incumbent", "same_name_candidate_count")
    return json.dumps(
        {"run_id": run_id, "created_at": created_at, "random_seed": seed, "total_sampled": len(rows), "by_gender": count("gender"), "by_city_size": count("city_size_bucket"), "by_nuance_group": count("nuance_group"),
         "distinct_regions": len(regions), "region_codes": regions, "candidates": [{k: r[k] for k in keep} for r in sorted(rows, key=lambda r: r["leader_id"])]},
        ensure_ascii=False, indent=2,
    )
