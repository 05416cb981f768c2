import datetime as dt

import pytest
from pyspark.sql import functions as F

from hustings.config import OUTLETS, Settings, arrondissement_parents
from hustings.operators import benchmark, dims, matching, news, quality, sampling, windows
from hustings.operators.errors import DataQualityError, SamplingError


def cog(spark, rows):
    return spark.createDataFrame(rows, "TYPECOM string, COM string, REG string, DEP string, LIBELLE string")


def seats(spark, rows):
    return spark.createDataFrame(rows, "CODE_COMMUNE string, LIB_COMMUNE string, CODE_DPT string, POPULATION string, NBRE_SAP_COM string, NBRE_SAP_EPCI string")


def test_commune_dim(spark):
    c = cog(spark, [("COM", "01001", "84", "01", "Abergement"), ("COM", "75056", "11", "75", "Paris"), ("ARM", "75101", "11", "75", "Paris 1er"), ("COM", "02001", "32", "02", "Petit"), ("COM", "03001", "84", "03", "Inconnu")])
    s = seats(spark, [("01001", "X", "01", "3500", "15", "1"), ("75056", "Y", "75", "2000000", "163", "n/a"), ("75056", "Z", "75", "1", "1", "1"), ("02001", "P", "02", "0", "7", "1")])
    parts = dims.commune_dim(c, s)
    rows = {r["commune_insee"]: r for r in parts.clean.collect()}
    assert parts.clean.columns == ["commune_insee", "commune_name", "dep_code", "reg_code", "seats_municipal", "seats_epci", "population", "city_size_bucket"]
    assert rows["75056"]["population"] == 2_000_000 and rows["75056"]["seats_epci"] is None and rows["75056"]["commune_name"] == "Paris"
    assert {k: r["city_size_bucket"] for k, r in rows.items()} == {"01001": "small", "75056": "large", "02001": "excluded", "03001": "excluded"}
    rejected = parts.rejected.collect()
    assert [(r["commune_insee"], r["_rejection_reason"]) for r in rejected] == [("75056", "duplicate commune_insee")]
    assert parts.clean.count() + parts.rejected.count() == 5


def test_commune_dim_gates(spark):
    c = cog(spark, [("COM", None, "84", "01", "A"), ("COM", "75056", "11", "75", "Paris")])
    s = seats(spark, [("75056", "Y", "75", "1", "1", "1")])
    with pytest.raises(DataQualityError, match="null rate"):
        dims.commune_dim(c, s)
    with pytest.raises(DataQualityError, match="seats join failed"):
        dims.commune_dim(c, s.withColumnRenamed("CODE_COMMUNE", "other"))
    lenient = dims.commune_dim(c, s, Settings(dq_max_null_rate=0.9))
    assert [r["_rejection_reason"] for r in lenient.rejected.collect()] == ["commune_insee is null"]


DIM = "commune_insee string, commune_name string, dep_code string, reg_code string, seats_municipal long, seats_epci long, population long, city_size_bucket string"


def communes(spark):
    return spark.createDataFrame([("75056", "Paris", "75", "11", 1, 1, 2_000_000, "large"), ("01001", "Ab", "01", "84", 1, 1, 100, "excluded"), ("13001", "Aix", "13", "93", 1, 1, 50_000, "medium")], DIM)


def candidates(spark, rows):
    return spark.createDataFrame(rows, "commune_insee string, family_name string, given_name string, gender string, list_nuance string, is_list_leader string")


def test_leader_dim(spark):
    rows = [
        ("75056", "DUPONT", "Jean-Luc", "M", "LDVG", "Oui"), ("75056", "DUPONT", "Jean Luc", "M", "LRN", "oui "), ("13001", "DURAND", "Marie", "F", "LXX", "OUI"), ("13001", "DURAND", "Marie", "F", "LXX", "Oui"),
        ("01001", "PETIT", "A", "F", "LRN", "Oui"), ("75101", "ARM", "B", "F", "LRN", "Oui"), ("75056", "LIST", "C", "F", "LRN", "Non"), ("75056", "ODD", "D", "X", "LRN", "Oui"),
    ]
    known = spark.createDataFrame([("75056", "DUPOND", "Jean-Luc"), ("13001", "AUTRE", "Personne")], "commune_insee string, family_name string, given_name string")
    second = candidates(spark, [("75056", "DUPONT", "Jean Luc", "M", "LDVG", "Oui")])
    parts = dims.leader_dim(candidates(spark, rows), communes(spark), known, second)
    clean = {r["full_name"]: r for r in parts.clean.collect()}
    assert set(clean) == {"DUPONT Jean-Luc", "DUPONT Jean Luc", "DURAND Marie"}
    assert clean["DUPONT Jean-Luc"]["same_name_candidate_count"] == 2 and clean["DURAND Marie"]["same_name_candidate_count"] == 2
    assert clean["DUPONT Jean-Luc"]["nuance_group"] == "gauche" and clean["DURAND Marie"]["nuance_group"] == "divers"
    assert clean["DUPONT Jean-Luc"]["is_incumbent"] is True and clean["DUPONT Jean-Luc"]["incumbent_match_auditable"] is True
    assert clean["DURAND Marie"]["is_incumbent"] is False and clean["DURAND Marie"]["incumbent_match_score"] < 85
    assert clean["DUPONT Jean-Luc"]["advanced_to_tour2"] is True and clean["DURAND Marie"]["advanced_to_tour2"] is False
    assert not {"commune_name", "dep_code", "population"} & set(parts.clean.columns) and len(parts.clean.columns) == 13
    assert sorted(r["_rejection_reason"] for r in parts.rejected.collect()) == ["commune_insee not in dim_commune", "duplicate leader_id", "gender not in {M, F}"]


def test_second_round_is_three_valued(spark):
    leaders = spark.createDataFrame([("75056", "A B"), ("75056", "")], "commune_insee string, full_name string")
    assert [r["advanced_to_tour2"] for r in dims.second_round(leaders, None).collect()] == [None, None]
    empty = candidates(spark, [("1", "x", "y", "M", "z", "Non")])
    assert {r["advanced_to_tour2"] for r in dims.second_round(leaders, empty).collect()} == {None}


def test_incumbents_without_rows_or_names(spark):
    leaders = spark.createDataFrame([("1", "A B"), ("2", "A B"), (None, "A B"), ("1", "")], "commune_insee string, full_name string")
    lookup = spark.createDataFrame([("1", "B A")], "commune_insee string, incumbent_name string")
    got = {(r["commune_insee"], r["full_name"]): (r["is_incumbent"], r["incumbent_match_score"]) for r in dims.match_incumbents(leaders, lookup).collect()}
    assert got == {("1", "A B"): (True, 100.0), ("2", "A B"): (False, None), (None, "A B"): (None, None), ("1", ""): (None, None)}


def test_a_blank_commune_has_no_score(spark):
    leaders = spark.createDataFrame([("", "A B"), (" ", "A C"), ("1", "A B")], "commune_insee string, full_name string")
    lookup = spark.createDataFrame([("", "B A"), (" ", "B A"), ("1", "B D")], "commune_insee string, incumbent_name string")
    got = {r["commune_insee"]: (r["is_incumbent"], r["incumbent_match_score"], r["incumbent_match_auditable"]) for r in dims.match_incumbents(leaders, lookup).collect()}
    assert got[""] == got[" "] == (None, None, False)
    # the common subsequence of A B and B D is one character of six
    assert got["1"] == (False, 200 / 6, True)


def test_many_to_one_is_checked(spark):
    twice = spark.createDataFrame([("a",), ("a",)], "k string")
    with pytest.raises(Exception, match="not unique"):
        quality.require_unique(twice, ["k"], "t").collect()


def pool(spark, spare=True):
    rows, regions, i = [], ["11", "84", "44", "24"], 0
    for bucket, n in (("large", 2), ("medium", 4), ("small", 6)):
        for g in ("F", "M"):
            for _ in range(n):
                rows.append((f"{i:032d}", f"N{i}", g, f"c{i}", regions[i % 4], bucket, 1, "LRN", "extreme_droite", None, None, False, None))
                i += 1
    if spare:
        rows.append((f"{i:032d}", "SPARE", "F", f"c{i}", "11", "large", 5, "LRN", "extreme_droite", None, None, False, None))
    leaders = spark.createDataFrame(rows, sampling.SAMPLE_LEADERS.rsplit(", commune_name", 1)[0])
    places = spark.createDataFrame([(r[3], "C" + r[3], "01", r[4], 1, 1, 1000, r[5]) for r in rows], DIM)
    return leaders, places


def test_sample_fills_quotas_whatever_the_order(spark):
    leaders, places = pool(spark)
    sample, warnings = sampling.build_sample(leaders, places)
    rows = sample.collect()
    assert len(rows) == 24 and not warnings and "SPARE" not in {r["full_name"] for r in rows}
    counts = sample.groupBy("city_size_bucket", "gender").count().collect()
    assert {(r[0], r[1]): r[2] for r in counts} == {("large", "F"): 2, ("large", "M"): 2, ("medium", "F"): 4, ("medium", "M"): 4, ("small", "F"): 6, ("small", "M"): 6}
    again, _ = sampling.build_sample(leaders.orderBy(F.rand(1)).repartition(7), places)
    assert {r["leader_id"] for r in rows} == {r["leader_id"] for r in again.collect()}
    text = sampling.manifest(sample, places, "r1", "2026-01-01", 42)
    assert '"run_id": "r1"' in text and '"total_sampled": 24' in text


def test_sample_errors(spark):
    leaders, places = pool(spark, spare=False)
    first = leaders.filter("city_size_bucket = 'large' AND gender = 'F'").first()["leader_id"]
    with pytest.raises(SamplingError, match="need 2 female"):
        sampling.build_sample(leaders.filter(F.col("leader_id") != first), places)
    with pytest.raises(SamplingError, match="nulls"):
        sampling.build_sample(leaders.withColumn("same_name_candidate_count", F.lit(None).cast("long")), places)
    with pytest.raises(SamplingError, match="no commune_name"):
        sampling.build_sample(leaders, places.limit(3))
    with pytest.raises(SamplingError, match="lacks columns"):
        sampling.build_sample(leaders.drop("gender"), places)


def test_regions_are_swapped_in(spark):
    leaders, places = pool(spark, spare=False)
    leaders = leaders.withColumn("reg_code", F.lit("11"))
    extra = leaders.filter("city_size_bucket = 'small'").limit(2).withColumns({"leader_id": F.concat(F.lit("x"), F.substring("leader_id", 2, 31)), "reg_code": F.when(F.col("full_name").endswith("2"), "84").otherwise("44"), "same_name_candidate_count": F.lit(9).cast("long")})
    sample, warnings = sampling.build_sample(leaders.unionByName(extra), places)
    assert sample.count() == 24 and sample.select("reg_code").distinct().count() >= 2 and warnings
    assert sample.filter("gender = 'F'").count() == 12


def cases(spark):
    return spark.createDataFrame([("l1", "PRÉCIGOUT Sandrine", "Terres-de-Haute-Charente", "16", "small", dt.date(2026, 3, 9), dt.date(2026, 3, 22))], "leader_id string, full_name string, commune_name string, dep_code string, city_size_bucket string, window_start date, window_end date")


@pytest.mark.parametrize(
    ("entry", "match", "read"),
    [
        ("Sandrine Précigout candidate", True, True), ("PRECIGOUT à Terres de Haute-Charente", True, True), ("Municipales : ce qui se passe en Haute-Charente", False, True),
        ("Précigout élue maire", False, True), ("La météo du jour", False, False), ("Sandrine et la liste", False, False), ("Précigout Sandrine", True, True),
    ],
)
def test_match_decisions(spark, entry, match, read):
    from hustings.functions.text import normalize_match

    s = matching.signals(F.col("x"))
    row = matching.match_terms(cases(spark)).withColumn("x", normalize_match(F.lit(entry))).select(s.matches, s.worth_reading).first()
    assert tuple(row) == (match, read)


def hits(spark, rows):
    full = [(p, "t", o, u, f"t{i}", dt.datetime(2026, 3, 10, 8, 30), "d", "fr", "raw", "q", "s", "l1", "N", "C", "16", "small", i) for i, (p, o, u) in enumerate(rows)]
    return spark.createDataFrame(full, "provider string, provider_tier string, outlet_key string, article_url string, title string, published_at timestamp, domain string, language string, raw_payload_path string, query_text string, query_strategy string, leader_id string, full_name string, commune_name string, dep_code string, city_size_bucket string, hit_seq long")


def test_articles_and_discoveries(spark):
    h = hits(spark, [("curated", "lemonde.fr", "https://www.lemonde.fr/article?id=1&utm_source=rss"), ("gnews", "lemonde.fr", "https://lemonde.fr/article?id=1&utm_medium=api"), ("gnews", "x.fr", "https://x.fr/2")])
    a, d = news.articles(h), news.discoveries(h)
    assert a.count() == 2 and d.count() == 3 and len(a.columns) == 12 and len(d.columns) == 16
    first = a.filter("canonical_url = 'https://lemonde.fr/article?id=1'").first()
    assert first["title"] == "t0" and first["fetch_status"] == "not_fetched" and first["partition_date"] == "2026-03-10" and first["is_duplicate"] is False
    assert news.duplicate_rate(h).first()[0] == pytest.approx(1 / 3)
    assert news.duplicate_rate(h.limit(0)).first()[0] is None


def test_benchmark_joins_and_metrics(spark):
    h = hits(spark, [("curated", "lemonde.fr", "https://www.lemonde.fr/a?utm_source=1"), ("gnews", "lemonde.fr", "https://lemonde.fr/a"), ("gnews", "x.fr", "https://x.fr/2")])
    truth = spark.createDataFrame([("b1", "l1", "lemonde.fr", "https://lemonde.fr/a/", "t", dt.date(2026, 3, 10)), ("b2", "l1", "y.fr", None, "t", None)], "benchmark_case_id string, leader_id string, expected_outlet_key string, manual_article_url string, manual_title string, manual_published_at date")
    audit = spark.createDataFrame([("l1", "curated", "tier_1", "success_hits", 1), ("l1", "gnews", "tier_3", "rate_limited", 2)], "leader_id string, provider string, provider_tier string, provider_status string, provider_hit_count long")
    fetched = spark.createDataFrame([("https://lemonde.fr/a", "success", "x" * 100)], "canonical_url string, fetch_status string, body_text string")
    result = benchmark.results(news.discoveries(h), truth, audit, fetched)
    assert result.count() == 3 and not [c for c in result.columns if c.endswith(("_x", "_y"))] and "query_provider_tier" in result.columns
    m = benchmark.summary(result, truth, audit, fetched, h).first()
    assert (m["truth_article_count"], m["matched_truth_article_count"], m["recall"], m["source_overlap_count"], m["provider_availability_rate"]) == (1, 1, 1.0, 2.0, 0.5)
    none = benchmark.recall(result, truth.filter("manual_article_url IS NULL")).first()
    assert none["recall"] is None


def test_status_chains(spark):
    v = lambda *a: [F.lit(x) for x in a]
    row = spark.range(1).select(
        news.outlet_status(*v(1, 0, 0, 0, 0)), news.outlet_status(*v(0, 0, 0, 0, 0)), news.outlet_status(*v(0, 1, 0, 0, 0)), news.outlet_status(*v(0, 1, 1, 0, 0)), news.outlet_status(*v(0, 1, 1, 1, 0)), news.outlet_status(*v(0, 1, 1, 1, 1)),
        news.fetch_status(F.lit(False), F.lit(True), F.lit(" " * 200)), news.fetch_status(F.lit(False), F.lit(True), F.lit("x" * 100)),
    ).first()
    assert list(row) == ["success_hits", "blocked", "fetched", "zero_entries", "parsed", "zero_hits", "too_short", "success"]


def test_windows(spark):
    b = spark.createDataFrame([(dt.date(2026, 2, 1), dt.date(2026, 4, 30))], "window_start date, window_end date")
    w = windows.request_windows(b)
    rows = w.orderBy("request_start").collect()
    assert len(rows) == 13 and rows[-1]["request_end"] == dt.date(2026, 4, 30)
    assert windows.split_near_cap(w.limit(1), F.lit(237)).count() == 7 and windows.split_near_cap(w.limit(1), F.lit(236)).count() == 1
    d = dt.date(2026, 3, 2)
    assert windows.provider_window("gnews", d, d + dt.timedelta(1))[0] == d - dt.timedelta(1)
    assert windows.provider_window("gnews", d, d + dt.timedelta(2))[0] == d and windows.provider_window("curated", d, d + dt.timedelta(1))[0] == d
    assert windows.resolve_window(None, None) == (dt.date(2026, 2, 1), dt.date(2026, 4, 30)) and windows.resolve_window(d, d, d, None) == (d, d)
    assert windows.daily_window(now=dt.datetime(2026, 3, 3, 1, tzinfo=dt.UTC), lookback=1) == (dt.date(2026, 3, 1), dt.date(2026, 3, 3))


def test_settings_and_catalog():
    assert len(OUTLETS) == 26 and sum(o.enabled for o in OUTLETS.values()) == 9
    assert len(arrondissement_parents()) == 45 and arrondissement_parents()["75101"] == "75056"
    s = Settings.from_env({"CANDIDATE_SAMPLE_SIZE": "12", "NEWS_PROVIDER_ORDER": "gdelt, ,gnews", "DQ_MAX_NULL_RATE": "0.1"})
    assert s.candidate_sample_size == 12 and s.news_provider_order == ("gdelt", "gnews") and s.dq_max_null_rate == 0.1
