import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hustings.functions import dates, keys, similarity, text, url


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_normalize_name(spark):
    pairs = {"JEAN-LUC": "JEAN LUC", "O'BRIEN": "O BRIEN", "O’BRIEN": "O BRIEN", None: "", "Élise": "ELISE", "François": "FRANCOIS", "  a   b ": "A B", "Straße": "STRASSE", "a b": "AB", "Œuvre": "UVRE", "": ""}
    assert column(spark, list(pairs), text.normalize_name) == list(pairs.values())


def test_nuance_drops_one_leading_l(spark):
    pairs = {"LDVG": "DVG", "LRN": "RN", "DVG": "DVG", None: "", "LR": "R", "LLR": "LR", "L": "L", " lrn ": "RN"}
    assert column(spark, list(pairs), text.normalize_nuance) == list(pairs.values())
    assert column(spark, ["LDVG", "LR", "LLR", "XX", None], text.nuance_bloc) == ["gauche", "divers", "droite", "divers", "divers"]


def test_match_text_and_tokens(spark):
    assert column(spark, ["Évêché-sur-l'Orne 12!", None, "ß œ"], text.normalize_match) == ["eveche sur l orne 12", "", ""]
    assert column(spark, ["Le Évêché de 12"], text.match_tokens) == [["eveche"]]
    assert column(spark, ["abcdef"], lambda c: text.any_token(c, F.array(F.lit("cde")))) == [True]


def test_family_given_and_aliases(spark):
    names = ["PRÉCIGOUT Sandrine", "DE LA TOUR Anne", "SOLO", ""]
    assert column(spark, names, lambda c: text.family_given(c)[0]) == ["PRÉCIGOUT", "DE LA TOUR", "SOLO", ""]
    assert column(spark, names, lambda c: text.family_given(c)[1]) == ["Sandrine", "Anne", "", ""]
    assert column(spark, ["LE-GOFF O'NEIL Élise"], lambda c: text.aliases(c)["natural_accented"]) == ["Élise Le-Goff O'Neil"]
    assert column(spark, ["LE-GOFF Élise"], lambda c: text.aliases(c)["normalized"]) == ["Elise Le Goff"]


def test_title_case_is_that_of_python(spark):
    values = ["LE-GOFF", "d'ARTAGNAN", "éCOLE 2b", "jean  luc", "x1y"]
    assert column(spark, values, text.title_case) == [v.title() for v in values]


def test_queries(spark):
    place = F.lit("Paris")
    assert column(spark, ["PRÉCIGOUT Sandrine"], lambda c: text.event_query(c, place)) == ['"Sandrine Précigout" AND "Paris" AND (municipales OR maire OR mairie OR liste)']
    assert column(spark, ["PRÉCIGOUT Sandrine"], lambda c: text.event_query(c, place, "relaxed")) == ['"Sandrine Precigout" AND "Paris"']
    with pytest.raises(ValueError, match="Unknown query mode"):
        text.event_query(F.lit("x"), place, "other")


def test_strip_html(spark):
    page = "<p>Daisy <b>Ya&iuml;ch</b></p><script>var a='<b>';\n</SCRIPT><style>x{}</style> &lt;3 &amp;lt;"
    out = column(spark, [page], text.strip_html)[0]
    assert "Daisy" in out and "var" not in out and "x{}" not in out and "<3" in out and "&lt;" in out


def test_path_tokens_and_lists(spark):
    assert column(spark, ["Éa b--C", "", None, "___"], lambda c: text.path_token(c, 4)) == ["a_b_", "unknown", "unknown", "unknown"]
    assert column(spark, ["a, b,,c "], text.split_list) == [["a", "b", "c"]]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_similarity_against_brute_force(spark):
    rnd = random.Random(3)
    pairs = [("".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 9))), "".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 9)))) for _ in range(150)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.lcs_length(F.col("a"), F.col("b")), similarity.token_sort_ratio(F.col("a"), F.col("b"))).collect()
    for a, b, lcs, ratio in rows:
        x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        assert lcs == _lcs(a, b)
        assert ratio == pytest.approx(200 * _lcs(x, y) / (len(x) + len(y)) if x or y else 100)
        assert 0 <= ratio <= 100


def test_canonical_url(spark):
    pairs = {
        "https://www.lemonde.fr/article?id=1&utm_source=rss": "https://lemonde.fr/article?id=1", "https://lemonde.fr/article?id=1&utm_medium=api": "https://lemonde.fr/article?id=1",
        " HTTP://WWW.Site.FR/A/b/?B=2&a=&FBCLID=x#top ": "http://site.fr/A/b?B=2&a=", "https://site.fr": "https://site.fr/", "//site.fr/x//": "https://site.fr/x", "https://site.fr/?ref=a": "https://site.fr/",
        "https://site.fr/a;p=1?q=a%20b": "https://site.fr/a?q=a+b",
    }
    got = column(spark, list(pairs), url.canonical_url)
    assert got == list(pairs.values())
    assert column(spark, got, url.canonical_url) == got


def test_sanitized_url_keeps_the_rest(spark):
    assert column(spark, ["https://a.fr/x?apikey=secret&q=1&KEY=2#f", "https://a.fr/x?token=s"], url.sanitized_url) == ["https://a.fr/x?q=1#f", "https://a.fr/x"]


def test_feed_times(spark):
    utc = lambda *a: dt.datetime(*a)
    values = ["Tue, 10 Mar 2026 08:30:00 +0100", "10 Mar 2026 08:30:00 GMT", "2026-03-10T08:30:00Z", "2026-03-10", "soon", "", None, "Tue, 10 Mar 2026 08:30:00"]
    got = column(spark, values, lambda c: dates.feed_time(c).cast("timestamp_ntz"))
    assert got == [utc(2026, 3, 10, 7, 30), utc(2026, 3, 10, 8, 30), utc(2026, 3, 10, 8, 30), utc(2026, 3, 10), None, None, None, utc(2026, 3, 10, 8, 30)]
    assert column(spark, ["20260310T083000Z", "x"], lambda c: dates.event_time(c).cast("timestamp_ntz")) == [utc(2026, 3, 10, 8, 30), None]


def test_window_bounds(spark):
    day = lambda s: F.lit(dt.date.fromisoformat(s))
    values = ["2026-03-09T00:00:00", "2026-03-22T23:59:59", "2026-03-08T23:59:59", "2026-03-23T00:00:00", None]
    got = column(spark, values, lambda c: dates.within(c.cast("timestamp"), day("2026-03-09"), day("2026-03-22")))
    assert got == [True, True, False, False, True]
    assert column(spark, ["2026-03-08", "2026-03-07", None], lambda c: dates.fresh_enough(c.cast("date"), day("2026-03-09"))) == [True, False, True]


def test_keys_keep_places_of_missing_parts(spark):
    import hashlib

    row = spark.range(1).select(keys.leader_key(F.lit("A"), F.lit(None).cast("string")), keys.discovery_key(F.lit("a"), F.lit("b"), F.lit(None).cast("string"), F.lit("d"), F.lit("e"))).first()
    assert row[0] == hashlib.md5(b"A|").hexdigest() and row[1] == hashlib.md5(b"a:b::d:e").hexdigest()


def test_unescape_html_is_the_librarys(spark):
    import html

    cases = ["a &amp; b", "&eacute;&ecirc;&ocirc;&#233;&#xE9;&#XE9", "&amp;lt;", "&notit; &notin; &NewLine;x", "&bogus; & &; &#; &#x;", "&#0;&#128;&#159;&#xD800;&#1114112;&#99999999999;", "&copy2026 &nbsp;&#8364;&#x1F600;", "&#11;&#xFFFF;&#xFDD0;&#13;", "no reference", "", "&NotEqualTilde;&acE;", "&lt;b&gt;" * 3, "tail &amp"]
    assert column(spark, cases, text.unescape_html) == [html.unescape(c) for c in cases]


def test_letters_of_any_base_lose_their_marks(spark):
    import unicodedata

    cases = ["ǿ ά Й", "Élise", "é", "ñ Ṩ ﬁ", "שָׁלוֹם", "한"]
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    got = column(spark, cases, text.deaccent)
    assert got[:-1] == [plain(c) for c in cases[:-1]] and got[-1] == "한"
