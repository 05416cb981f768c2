"""Queries that once did less than the whole job, against brute force without blocks or subsets."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from hustings.functions import similarity
from hustings.operators import dims, marts
from hustings.plans import catalogue


def all_pairs(rows, least):
    ids = np.array([r["vec_id"] for r in rows])
    v = np.array([r["embedding"] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(v @ v.T >= least, 1))
    return {(min(a, b), max(a, b)) for a, b in zip(ids[i].tolist(), ids[j].tolist(), strict=True)}


def sql_rows(sf, table, sql):
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        return sorted(con.sql(sql).fetchall())


def test_embedding_dups_has_every_pair(spark, sf):
    want = all_pairs(catalogue.t(spark, sf, "embeddings").collect(), 0.3)
    got = catalogue.QUERIES["embedding_dups"](spark, sf).collect()
    assert len(want) > 900 and sorted((r["a"], r["b"]) for r in got) == sorted(want)


def test_embedding_dups_is_its_sql_without_block(spark, sf):
    sql = catalogue.SQL["embedding_dups"]
    lifted = sql.replace("a.block = b.block AND ", "")
    assert lifted != sql
    got = sorted(map(tuple, catalogue.QUERIES["embedding_dups"](spark, sf).collect()))
    assert got == sql_rows(sf, "embeddings", lifted)
    # of one block, the query has the SQL's rows
    block = {r["vec_id"]: (r["label"], *(x > 0 for x in r["embedding"][:3])) for r in catalogue.t(spark, sf, "embeddings").collect()}
    cut = sql_rows(sf, "embeddings", sql)
    assert 0 < len(cut) < len(got) and [r for r in got if block[r[0]] == block[r[1]]] == cut


def test_embedding_dups_at_the_threshold_is_its_sql(spark, tmp_path):
    # one block; (1, 1, 3, 3) and (3, 3, 1, -1) have 6 / 20, and 6 / (sqrt(20) * sqrt(20)) in doubles is less than 0.3
    near = [(1, 1, 3), (3, 3, 1), (6, 6, 2), (1, 2, 3), (3, 6, 2), (1, 2, 6), (3, 6, 1)]
    rows = [(k, [float(x) for x in (*v, last)], 1) for k, (v, last) in enumerate((v, last) for v in near for last in range(-6, 7))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = sorted(con.sql(catalogue.SQL["embedding_dups"]).fetchall())
    at = [(a, b) for a, b, s in want if s == 0.3]
    assert len(at) == 8 and sorted(map(tuple, catalogue.QUERIES["embedding_dups"](spark, str(tmp_path)).collect())) == want


def test_embedding_dups_rounds_as_its_sql(spark, tmp_path):
    # one block; with the first vector 323 / 640 and such have a 5 as seventh and last digit, and the SQL's round takes them down
    vectors = [(1, 0, 0, 0, 0, 0, 0), (323, 0, 0, 551, 38, 15, 1), (333, 0, 0, 545, 41, 2, 1), (1613, 0, 0, 2762, 81, 55, 1), (1615, 0, 0, 2762, 51, 23, 1)]
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = sorted(con.sql(catalogue.SQL["embedding_dups"]).fetchall())
    assert len(want) == 10 and want[:4] == [(0, 1, 0.504687), (0, 2, 0.520312), (0, 3, 0.504062), (0, 4, 0.504687)]
    assert sorted(map(tuple, catalogue.QUERIES["embedding_dups"](spark, str(tmp_path)).collect())) == want


def test_embedding_dups_sums_ties_of_long_vectors_as_its_sql(spark, tmp_path):
    # each of 50 blocks repeats the same five vectors at 110 scales: cosines stay, and 770 terms have another sum in blocks than in order
    vectors = [(1, 0, 0, 0, 0, 0, 0), (323, 0, 0, 551, 38, 15, 1), (333, 0, 0, 545, 41, 2, 1), (1613, 0, 0, 2762, 81, 55, 1), (1615, 0, 0, 2762, 51, 23, 1)]
    rng = np.random.default_rng(5)
    scales = np.ldexp(rng.integers(1, 1 << 12, (50, 110)).astype(float), rng.integers(-8, 9, (50, 110)))
    rows = [(5 * k + n, np.outer(s, v).ravel().tolist(), k) for k, s in enumerate(scales) for n, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = sorted(con.sql(catalogue.SQL["embedding_dups"]).fetchall())
    got = sorted(map(tuple, catalogue.QUERIES["embedding_dups"](spark, str(tmp_path)).collect()))
    assert len(want) == 500 and {s for a, b, s in want if b == a + 1 and a % 5 == 0} == {0.504687, 0.504688}
    assert [r for r in got if r[0] // 5 == r[1] // 5] == want


def test_embedding_pairs_thresholds_are_sums_in_order(spark, sf):
    df = catalogue.t(spark, sf, "embeddings").filter("vec_id < 100")
    v = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.collect()}

    # unlike sum, cumsum adds in order
    def cosine(a, b):
        dot, x, y = (np.cumsum(p)[-1] for p in (a * b, a * a, b * b))
        return dot / np.sqrt(x * y)

    pairs = sorted((cosine(v[a], v[b]), a, b) for a in v for b in v if a < b)
    for k in range(-40, 0, 5):
        got = marts.embedding_pairs(df, float(pairs[k][0])).collect()
        assert sorted((r["a"], r["b"]) for r in got) == sorted((a, b) for _, a, b in pairs[k:])


def test_embedding_pairs_in_tiles(spark, sf, monkeypatch):
    monkeypatch.setattr(marts, "TILE", 90)
    monkeypatch.setattr(marts, "CELLS", 500)
    df = catalogue.t(spark, sf, "embeddings")
    got = marts.embedding_pairs(df, 0.3).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(all_pairs(df.collect(), 0.3))


def test_embedding_pairs_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [4.0]), (9, [None, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, marts.embedding_pairs(df, 0.9).collect())) == [(1, 2, 1.0), (1, 2, 1.0), (7, 8, 1.0)]
    assert marts.embedding_pairs(df.limit(0), 0.9).count() == 0


def ratio(a, b):
    """200 x longest common subsequence of the sorted words over both lengths."""
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b))


def test_incumbent_match_takes_all_parts(spark, sf):
    parts = {(r["p_brand"], r["p_name"], r["p_size"]) for r in catalogue.t(spark, sf, "part").collect()}
    want = []
    for brand, name, size in parts:
        score = max(ratio(name.upper(), other.upper()) for b, other, _ in parts if b == brand)
        want.append((brand, name, size, score >= 85, round(score, 6), score < 100))
    assert sorted(map(tuple, catalogue.QUERIES["incumbent_match"](spark, sf).collect())) == sorted(want)


def test_incumbent_match_is_its_sql_without_sizes(spark, sf):
    sql = catalogue.SQL["incumbent_match"]
    lifted = sql.replace(" WHERE p_size > 45", "").replace(" WHERE p_size < 5", "")
    assert sql.count("WHERE") == 3 and "WHERE" not in lifted
    whole = sql_rows(sf, "part", lifted)
    assert sorted(map(tuple, catalogue.QUERIES["incumbent_match"](spark, sf).collect())) == whole
    # the operator on the parts of the SQL has the SQL's rows
    n = catalogue.t(spark, sf, "part").selectExpr("p_brand AS commune_insee", "p_name AS full_name", "p_size").distinct()
    known = n.filter("p_size > 45").selectExpr("commune_insee", "upper(full_name) AS incumbent_name").distinct()
    got = dims.match_incumbents(n.filter("p_size < 5"), known).selectExpr("commune_insee", "full_name", "p_size", "is_incumbent", "round(incumbent_match_score, 6)", "incumbent_match_auditable")
    cut = sql_rows(sf, "part", sql)
    assert len(cut) < len(whole) and sorted(map(tuple, got.collect())) == cut


def test_incumbents_of_other_names_against_brute_force(spark):
    names = ["SMALL RING", "RING SMAL", "COLD GIZMO", "HOT BOLT", "NEW BOLTS"]
    known = [("1", "SMALL RINGS"), ("1", "GIZMOS COLD"), ("2", "HOT BELT"), ("2", "BOLT NEW")]
    leaders = spark.createDataFrame([(c, n) for c in "12" for n in names], "commune_insee string, full_name string")
    got = dims.match_incumbents(leaders, spark.createDataFrame(known, "commune_insee string, incumbent_name string")).collect()
    for r in got:
        score = max(ratio(r["full_name"], n) for c, n in known if c == r["commune_insee"])
        assert abs(r["incumbent_match_score"] - score) < 1e-9 and r["is_incumbent"] is (score >= 85) and r["incumbent_match_auditable"] is (score < 100)
    assert len(got) == 10 and {r["is_incumbent"] for r in got} == {True, False}


def test_equal_names_need_no_comparison(spark, tmp_path, monkeypatch):
    # 9,000,000 pairs of one brand; each name has itself, or its words in another order, among the incumbents
    spark.range(3000).selectExpr("'B' AS p_brand", "concat_ws(' ', 'Ring', cast(id AS string)) AS p_name", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(similarity, "lcs_length", lambda a, b: F.raise_error(F.lit("compared")).cast("int"))
    got = catalogue.QUERIES["incumbent_match"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(("B", f"Ring {i}", 1, True, 100.0, False) for i in range(3000))
    leaders = spark.createDataFrame([("1", "A B"), ("2", "C  d")], "commune_insee string, full_name string")
    known = spark.createDataFrame([("1", "B A"), ("1", "B A C"), ("2", "D C"), ("2", None)], "commune_insee string, incumbent_name string")
    assert [r["incumbent_match_score"] for r in dims.match_incumbents(leaders, known).collect()] == [100.0, 100.0]


def test_equal_and_other_names_of_a_commune(spark):
    names = ["SMALL RING", "RING SMALL", "SMALL RINGS", "COLD GIZMO"]
    known = [("1", "RING  SMALL"), ("1", "GIZMOS COLD"), ("1", ""), ("1", None), ("2", "COLD GIZMO"), (None, "SMALL RING"), ("3", None)]
    leaders = spark.createDataFrame([(c, n) for c in "123" for n in names], "commune_insee string, full_name string")
    got = dims.match_incumbents(leaders, spark.createDataFrame(known, "commune_insee string, incumbent_name string")).collect()
    for r in got:
        score = max((ratio(r["full_name"], n) for c, n in known if c == r["commune_insee"] and n is not None), default=None)
        assert r["incumbent_match_score"] == score and r["is_incumbent"] is ((score or 0) >= 85) and r["incumbent_match_auditable"] is (score is not None and score < 100)
    assert len(got) == 12
