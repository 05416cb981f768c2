import datetime as dt
import io
import json
import zipfile
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from hustings.config import Settings
from hustings.plans import flows
from hustings.plans.lineage import Lineage, latest_hash
from hustings.sources import feeds, files, http, providers, writers
from hustings.sources.http import Reply

NOW = dt.datetime(2026, 3, 1, tzinfo=dt.UTC)


@pytest.fixture(scope="module", autouse=True)
def _by_value():
    """Workers get this module's transports themselves: they can't import it."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def workbook(rows):
    def cell(c, i, v):
        return f'<c r="{chr(65 + c)}{i}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f'<row r="{i}">' + "".join(cell(c, i, v) for c, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_csv_keeps_zeros_and_falls_back_to_latin1(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("COM,DEP,LIBELLE\n01001,01,Abergement-Clémenciat\n75056,75,Paris\n".encode())
    df = files.read_csv(spark, str(tmp_path / "a.csv"), ",")
    assert [tuple(r)[:3] for r in df.collect()] == [("01001", "01", "Abergement-Clémenciat"), ("75056", "75", "Paris")]
    assert {t for c, t in df.dtypes if c != "_row_seq"} == {"string"}
    (tmp_path / "b.csv").write_bytes("Nom;Prénom\nÉlu;Zoé\n".encode("latin-1"))
    assert files.read_csv(spark, str(tmp_path / "b.csv")).columns[:2] == ["Nom", "Prénom"]
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "c.csv").write_text("a;b\n")
    with pytest.raises(ValueError, match="no rows"):
        files.read_csv(spark, str(tmp_path / "c.csv"))


def test_workbook(spark, tmp_path):
    p = tmp_path / "s.xlsx"
    p.write_bytes(workbook([["CODE_COMMUNE", "POPULATION"], ["01001", "3500"]]))
    assert [tuple(r)[:2] for r in files.read_workbook(spark, str(p)).collect()] == [("01001", "3500")]
    assert files.read_workbook(spark, str(p), "Data").count() == 1
    for bad in (5, "Other"):
        with pytest.raises(ValueError):
            files.read_workbook(spark, str(p), bad)
    p.write_text("not a workbook")
    with pytest.raises(ValueError):
        files.read_workbook(spark, str(p))


def test_md5_download_and_counts(spark, tmp_path):
    path, first = http.download("u", str(tmp_path / "d/x.bin"), lambda _: iter([b"ab", b"c"]))
    before = (tmp_path / "d/x.bin").stat().st_mtime_ns
    assert http.download("u", path, lambda _: iter([b"abc"]))[1] == first and (tmp_path / "d/x.bin").stat().st_mtime_ns == before
    assert files.file_md5(spark, path).first()["md5"] == first and len(list((tmp_path / "d").iterdir())) == 1
    spark.range(7).write.parquet(str(tmp_path / "t"))
    assert files.row_count(spark, str(tmp_path / "t")) == 7


def test_fetch_retries_and_hides_secrets():
    calls, waits = [], []

    def transport(status):
        def f(url, timeout):
            calls.append(url)
            return Reply(status[min(len(calls), len(status)) - 1], "ok", url)

        return f

    text, url, error = http.fetch("https://a.fr/?apikey=s&q=1", transport([429, 200]), sleep=waits.append)
    assert (text, url, error, waits) == ("ok", "https://a.fr/?q=1", "", [30.0])
    calls.clear(), waits.clear()
    assert http.fetch("https://a.fr/", transport([0]), sleep=waits.append)[2] == "connection_error" and waits == [5, 10] and len(calls) == 3
    calls.clear()
    assert http.fetch("https://a.fr/", transport([404]), sleep=waits.append)[2] == "http_404" and len(calls) == 1


RSS = "<rss><channel><item><title><![CDATA[Sandrine Précigout &amp; Co]]></title><link>https://x.fr/1</link><pubDate>Tue, 10 Mar 2026 08:30:00 +0000</pubDate></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="https://x.fr/2"/><updated>2026-03-10T08:30:00Z</updated></entry></feed>'
SITEMAP = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x.fr/3</loc><lastmod>2026-03-11</lastmod></url></urlset>'
INDEX = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://x.fr/old.xml</loc><lastmod>2015-01-01</lastmod></sitemap><sitemap><loc>https://x.fr/new.xml</loc></sitemap></sitemapindex>'


def test_feeds(spark):
    docs = spark.createDataFrame([("r", RSS), ("a", ATOM), ("s", SITEMAP), ("i", INDEX), ("bad", "<!doctype html><html>not xml</html>"), ("cut", "<rss><channel><item>"), ("null", None)], "k string, body string")
    parsed = feeds.parse_documents(docs)
    assert {r["k"] for r in parsed.filter("parsed").collect()} == {"r", "a", "s"}
    rows = {r["k"]: r for r in feeds.explode_entries(parsed, ["k"]).collect()}
    assert rows["r"]["title"] == "Sandrine Précigout & Co" and rows["a"]["link"] == "https://x.fr/2" and rows["s"]["title"] == "https://x.fr/3" and rows["s"]["published_at"] is not None
    children = feeds.wanted_children(docs.filter(feeds.is_index(F.col("body"))), "body", F.lit(dt.date(2026, 3, 9)), 20, ["k"]).collect()
    assert [r["url"] for r in children] == ["https://x.fr/new.xml"]


CASE = "leader_id string, full_name string, commune_name string, dep_code string, city_size_bucket string, window_start date, window_end date"
WINDOW = (dt.date(2026, 3, 9), dt.date(2026, 3, 22))


def cases(spark):
    return spark.createDataFrame([("l1", "PRÉCIGOUT Sandrine", "Terres-de-Haute-Charente", "16", "small", *WINDOW)], CASE)


def web(url, timeout):
    pages = {
        "https://x.fr/rss": RSS, "https://x.fr/index": INDEX, "https://x.fr/new.xml": SITEMAP.replace("https://x.fr/3", "https://x.fr/municipales-haute-charente"),
        "https://x.fr/municipales-haute-charente": "<p>Sandrine Pr&eacute;cigout est candidate</p>", "https://x.fr/bad": "<html>no</html>",
    }
    return Reply(200, pages[url], url) if url in pages else Reply(404, "", url)


def test_curated(spark):
    roots = spark.createDataFrame([("x.fr", "X", "historical_capable", 0, "https://x.fr/rss"), ("x.fr", "X", "historical_capable", 1, "https://x.fr/index"), ("y.fr", "Y", "realtime_only", 2, "https://x.fr/bad"), ("z.fr", "Z", "realtime_only", 3, "https://x.fr/gone")], "outlet_key string, display_name string, connector_capability string, doc_seq long, url string")
    bundle = providers.curated_bundle(spark, roots, WINDOW, web, sleep=_no_wait)
    assert {r["url"] for r in bundle.collect()} == {"https://x.fr/rss", "https://x.fr/index", "https://x.fr/bad", "https://x.fr/gone", "https://x.fr/new.xml"}
    found = providers.curated(cases(spark), bundle, providers.article_reader(web, sleep=_no_wait))
    hits = {r["article_url"]: r["query_strategy"] for r in found.hits.collect()}
    assert hits == {"https://x.fr/1": "rss_sitemap_filter", "https://x.fr/municipales-haute-charente": "rss_sitemap_body_verify"}
    status = {r["outlet_key"]: (r["outlet_status"], r["warning_count"]) for r in found.diagnostics.collect()}
    assert status == {"x.fr": ("success_hits", 0), "y.fr": ("fetched", 1), "z.fr": ("blocked", 1)}
    audit = found.audits.first()
    assert audit["provider_status"] == "success_hits" and audit["provider_hit_count"] == 2 and audit["provider_warning_count"] == 2


def _no_wait(seconds):
    return None


def event_web(url, timeout):
    q = parse_qs(urlsplit(url).query)
    if "query" not in q:
        return Reply(200, f"<p>{'texte ' * 40}</p>", url)
    if "AND (municipales" in q["query"][0]:
        return Reply(200, '{"articles": []}', url)
    day = q["startdatetime"][0][:8]
    return Reply(200, json.dumps({"articles": [{"url": f"https://www.a.fr/{day}?utm_source=g", "title": "t", "seendate": f"{day}T083000Z", "domain": "www.A.fr", "language": "French"}, {"url": "https://a.fr/same", "title": "s", "seendate": "x", "domain": "", "language": None}]}), url)


def test_event_index_falls_back_and_splits(spark):
    found = providers.event_index(cases(spark), event_web, sleep=_no_wait)
    rows = found.hits.orderBy("hit_seq").collect()
    assert [r["article_url"] for r in rows] == ["https://www.a.fr/20260309?utm_source=g", "https://a.fr/same", "https://www.a.fr/20260316?utm_source=g"]
    assert rows[0]["query_strategy"] == "relaxed" and rows[0]["domain"] == "a.fr" and rows[1]["outlet_key"] == "gdelt" and rows[1]["published_at"] is None and rows[1]["language"] == "fr"
    assert found.audits.first()["provider_status"] == "success_hits"
    limited = providers.event_index(cases(spark), lambda u, t: Reply(429, "", u), sleep=_no_wait)
    assert limited.audits.first()["provider_status"] == "rate_limited" and limited.hits.count() == 0
    broken = providers.event_index(cases(spark), lambda u, t: Reply(200, "<html>", u), sleep=_no_wait)
    assert broken.audits.first()["provider_error_type"] == "parse_error"


def search_web(url, timeout):
    page = int(parse_qs(urlsplit(url).query)["page"][0])
    if page == 3:
        return Reply(500, "", url)
    return Reply(200, json.dumps({"articles": [{"url": f"https://b.fr/{i}", "title": "t", "publishedAt": "2026-03-10T08:30:00Z"} for i in range(10 * page - 10, 10 * page)] + [{"url": "https://b.fr/0?utm_source=x", "title": "again", "publishedAt": ""}]}), url)


def test_search_api_pages(spark):
    found = providers.search_api(cases(spark), search_web, Settings(gnews_api_key="secret"), _no_wait)
    assert found.hits.count() == 20 and found.raw.count() == 2
    audit = found.audits.first()
    assert audit["provider_status"] == "error" and "secret" not in audit["request_url"] and audit["provider_hit_count"] == 20
    assert not [r for r in found.raw.collect() if "secret" in r["source_url"]]
    none = providers.search_api(cases(spark), search_web, Settings(), _no_wait)
    assert none.audits.first()["provider_error_type"] == "missing_api_key" and none.hits.count() == 0
    with pytest.raises(ValueError):
        providers.provider("other")


def test_writers(spark, tmp_path):
    from hustings.operators.quality import Split

    good, bad = spark.range(3), spark.range(1).withColumn("_rejection_reason", F.lit("x"))
    at = str(tmp_path / "t")
    assert writers.write_split(Split(good, bad), at) == [at, at + "_rejected"]
    assert writers.write_split(Split(good, bad.limit(0)), at) == [at] and not files.exists(spark, at + "_rejected")
    rows = spark.createDataFrame([("2026-03-09", "2026-03-22", "gdelt", "0123", "u")], "window_start string, window_end string, provider string, leader_id string, article_url string")
    back = writers.read_bronze(spark, writers.write_bronze(rows, str(tmp_path / "b")))
    assert back.schema == rows.schema and back.first()["leader_id"] == "0123"
    with pytest.raises(ValueError, match="budget"):
        writers.check_path_budget(["x" * 241])
    raw = spark.createDataFrame([("k1", "https://a.fr", "{}", 1, "lid")], "raw_document_key string, source_url string, payload string, row_count int, leader_id string")
    docs = writers.raw_documents(raw, str(tmp_path / "raw"), "gdelt", F.lit(WINDOW[0]), F.lit(WINDOW[1]))
    paths = writers.write_raw(docs)
    assert len(paths) == 1 and "scope=leader_i_lid_" in paths[0] and "window=20260309_20260322" in paths[0]
    with pytest.raises(Exception, match="budget"):
        writers.raw_documents(raw, "x" * 230, "gdelt", F.lit(WINDOW[0]), F.lit(WINDOW[1])).collect()
    assert writers.save_as(good, "tests_db.t") == 3 and writers.save_as(good.limit(1), "tests_db.t") == 1


def test_lineage(spark, tmp_path):
    log = Lineage(spark, str(tmp_path / "meta"))
    log.log_snapshot("a", "u", "h1", "p", 1, NOW)
    log.log_snapshot("a", "u", "h1", "p", 1, NOW)
    log.log_snapshot("a", "u", "h2", "p", 1, NOW + dt.timedelta(days=1))
    assert log.snapshots.count() == 2 and latest_hash(log.snapshots, "a") == "h2" and latest_hash(log.snapshots, "b") is None
    log.log_run("r", "f", NOW, NOW, "partial", 1, 1, ["p"])
    log.log_run("r", "f", NOW, NOW, "success", 2, 0, ["p", "q"])
    assert [(r["status"], r["artifact_paths"]) for r in log.runs.collect()] == [("success", '["p", "q"]')]
    with pytest.raises(ValueError):
        log.log_run("r", "f", NOW, NOW, "odd", 1, 1, [])


def raw_files(tmp_path, second=True):
    base = tmp_path / "raw"
    base.mkdir()
    strata = [("large", 150_000, 2), ("medium", 50_000, 4), ("small", 10_000, 6)]
    cog, seats, people = ["TYPECOM,COM,REG,DEP,LIBELLE"], [["CODE_COMMUNE", "POPULATION", "NBRE_SAP_COM", "NBRE_SAP_EPCI"]], ["Code circonscription;Nom sur le bulletin de vote;Prénom sur le bulletin de vote;Sexe;Code nuance de liste;Tête de liste"]
    i = 0
    for _, population, n in strata:
        for g in "FM":
            for _ in range(n):
                code = f"0{1000 + i}"
                cog.append(f"COM,{code},{('11', '84', '44', '24')[i % 4]},01,Ville {i}")
                seats.append([code, str(population), "15", "1"])
                people.append(f"{code};NOM{chr(65 + i)};Prénom;{g};LDVG;Oui")
                i += 1
    (base / "geography.csv").write_text("\n".join(cog))
    (base / "seats.xlsx").write_bytes(workbook(seats))
    (base / "candidates.csv").write_text("\n".join(people))
    (base / "incumbents.csv").write_text("Code de la commune;Nom de l'élu;Prénom de l'élu\n01000;NOMA;Prénom\n")
    if second:
        (base / "tour2.csv").write_text("\n".join(people[:3]))
    kinds = {"geography": ("csv", ",", "csv"), "seats": ("xlsx", "", "xlsx"), "candidates": ("csv", ";", "csv"), "incumbents": ("csv", ";", "csv"), "tour2": ("csv", ";", "csv")}
    return {k: flows.Source(k, f"https://data.fr/{k}", str(base / f"{k}.{e}"), kind, sep) for k, (kind, sep, e) in kinds.items()}


@pytest.mark.parametrize("second", [True, False])
def test_sampling_flow(spark, tmp_path, second):
    log = Lineage(spark, str(tmp_path / "meta"))
    run = flows.sampling_flow(spark, raw_files(tmp_path, second), str(tmp_path / "out"), lineage=log, now=lambda: NOW)
    assert run.status == ("success" if second else "partial") and run.error_count == int(not second)
    sample = spark.read.parquet(str(tmp_path / "out/gold/sample_leaders"))
    assert sample.count() == 24 and sample.filter("is_incumbent").count() == 1
    assert sample.filter("advanced_to_tour2 IS NULL").count() == (0 if second else 24)
    assert files.read_cases(spark, str(tmp_path / "out/gold/sample_manifest.json"), WINDOW).count() == 24
    assert log.runs.first()["status"] == run.status and log.snapshots.count() == (5 if second else 4)


def test_failed_flow_is_logged(spark, tmp_path):
    log = Lineage(spark, str(tmp_path / "meta"))
    sources = raw_files(tmp_path)
    (tmp_path / "raw/candidates.csv").unlink()
    with pytest.raises(FileNotFoundError):
        flows.sampling_flow(spark, sources, str(tmp_path / "out"), lineage=log)
    assert log.runs.first()["status"] == "failed"


def test_news_and_benchmark_flows(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"candidates": [{"leader_id": "l1", "full_name": "PRÉCIGOUT Sandrine", "commune_name": "Terres-de-Haute-Charente", "dep_code": "16", "city_size_bucket": "small"}]}))
    log = Lineage(spark, str(tmp_path / "meta"))
    run = flows.backfill_flow(spark, str(tmp_path / "m.json"), str(tmp_path / "out"), event_web, start=WINDOW[0], end=WINDOW[1], lineage=log, sleep=_no_wait)
    assert run.status == "success" and run.metrics["hit_count"] == 3
    back = writers.read_bronze(spark, str(tmp_path / "out/bronze/news_hits"))
    assert back.count() == 3 and back.filter("_source_hash = ''").count() == 0
    partial = flows.daily_flow(spark, str(tmp_path / "m.json"), str(tmp_path / "d"), search_web, dt.date(2026, 3, 10), ("gnews",), lineage=log, sleep=_no_wait)
    assert partial.status == "partial" and log.runs.count() == 2
    manifest = json.dumps({"benchmark_window": {"start": "2026-03-09", "end": "2026-03-22"}, "curated_outlets": ["a.fr"], "candidates": [{"leader_id": "l1", "full_name": "PRÉCIGOUT Sandrine", "commune_name": "Terres", "dep_code": "16", "city_size_bucket": "small"}],
                           "manual_truth_articles": [{"benchmark_case_id": "b1", "leader_id": "l1", "expected_outlet_key": "a.fr", "manual_article_url": "https://www.a.fr/20260309", "manual_title": "t", "manual_published_at": "2026-03-09"}]})
    people, truth, outlets = files.read_benchmark_manifest(spark, manifest)
    assert outlets == ("a.fr",)
    result = flows.benchmark_flow(spark, people, truth, str(tmp_path / "b"), event_web, ("gdelt",), lineage=log, sleep=_no_wait)
    assert result.metrics["recall"] == 1.0 and result.metrics["truth_article_count"] == 1 and len(result.artifact_paths) == 5


def test_stream_drops_repeats(spark, tmp_path):
    from hustings.operators.contracts import SEARCH_HIT, conform
    from hustings.streaming import articles

    rows = [("curated", "https://www.a.fr/1?utm_source=x", dt.datetime(2026, 3, 10)), ("gnews", "https://a.fr/1", dt.datetime(2026, 3, 10, 1)), ("gnews", "https://a.fr/2", dt.datetime(2026, 3, 10, 2))]
    conform(spark.createDataFrame(rows, "provider string, article_url string, published_at timestamp"), SEARCH_HIT).write.parquet(str(tmp_path / "in"))
    hits = articles.hit_stream(spark, str(tmp_path / "in"))
    articles.run_once(articles.first_seen(hits), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r["canonical_url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"https://a.fr/1", "https://a.fr/2"}
    articles.run_once(articles.counts_by_window(hits), str(tmp_path / "w"), str(tmp_path / "cp2"))


def test_command_line_fails_with_one(spark, capsys, monkeypatch, tmp_path):
    from hustings.__main__ import main

    monkeypatch.setenv("WAREHOUSE_PATH", str(tmp_path / "w"))
    assert main(["sample", "--sources", "/nowhere", "--out", "/tmp/hustings-none"]) == 1
    assert "failed" in capsys.readouterr().err


def test_malformed_feeds_are_refused(spark):
    bad = ["<rss><channel><item><title>A & B <b></title></item></channel></rss>", "<rss><channel></rss>", RSS + "<", SITEMAP.replace("x.fr/3", "x.fr/&eacute;"), "text", ""]
    rows = feeds.parse_documents(spark.createDataFrame([(b,) for b in bad], "body string")).collect()
    assert [(r["parsed"], list(r["entries"])) for r in rows] == [(False, [])] * len(bad)
    many = "<rss version='2.0'><channel><title>t</title>" + "".join(f"<item><title>n{i}</title><link> https://x.fr/{i} </link></item>" for i in range(30)) + "</channel></rss>"
    plain = "<rdf:RDF xmlns:rdf='r' xmlns='s'><item><title type='x'>a</title></item></rdf:RDF>"
    empty = "<rss><channel><title>none</title></channel></rss>"
    got = feeds.parse_documents(spark.createDataFrame([(many,), (plain,), (empty,)], "body string")).collect()
    assert [len(r["entries"]) for r in got] == [30, 1, 0] and all(r["parsed"] for r in got)
    assert got[0]["entries"][7] == ("n7", "https://x.fr/7", "") and got[1]["entries"][0]["title"] == "a"


def test_bronze_folders_have_plain_names(spark, tmp_path):
    rows = spark.createDataFrame([("2026-03-09", "2026-03-22", "gdelt", f"0{k}", f"u{k}") for k in range(3)], "window_start string, window_end string, provider string, leader_id string, article_url string")
    root = writers.write_bronze(rows, str(tmp_path / "b"))
    assert (tmp_path / "b/window_start=2026-03-09/window_end=2026-03-22/provider=gdelt/leader_id=01").is_dir()
    one = writers.read_bronze(spark, root).filter("leader_id = '01'")
    assert [tuple(r) for r in one.collect()] == [("2026-03-09", "2026-03-22", "gdelt", "01", "u1")] and len(one.inputFiles()) == 3
    assert "PartitionFilters: [isnotnull(leader_id" in one._jdf.queryExecution().toString()


def test_public_names():
    import hustings

    for name in hustings.__all__:
        assert getattr(hustings, name) is not None
    with pytest.raises(AttributeError):
        hustings.nothing


def test_source_hashes_are_the_files(spark, tmp_path):
    import hashlib

    sources = raw_files(tmp_path)
    log = Lineage(spark, str(tmp_path / "meta"))
    out = flows.ingest(spark, sources["geography"], str(tmp_path / "bronze"), log)
    want = hashlib.md5((tmp_path / "raw/geography.csv").read_bytes()).hexdigest()
    assert {r["_source_hash"] for r in out.collect()} == {want} and latest_hash(log.snapshots, "geography") == want
