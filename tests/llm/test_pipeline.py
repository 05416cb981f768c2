import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(12)
    d = str(tmp_path_factory.mktemp("sf"))
    words = lambda n: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, ("grobnak " if bad else "") + words(rnd.randint(40, 120)), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    item = words(30)
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000, clean[0][1], "en", "s", 1), (1001, clean[1][1] + " ", "en", "s", 1), (1002, clean[2][1] + " extra", "en", "s", 1), (1003, words(50) + " " + item + " " + words(50), "en", "s", 1), (1004, None, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {r[0]: r[1] for r in rows}


def test_each_stage_takes_effect(spark, tables):
    d, texts = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        now = {r[0] for r in out.select("doc_id").collect()}
        gone, kept = kept - now, now
        if name == "toxicity":
            toxic = {i for i in gone if (texts[i] or "").startswith("grobnak")}
            assert len(toxic) >= 115 and len(gone - toxic) <= 6
        elif name == "exact_dedup":
            first, second = [i for i in sorted(texts) if i % 5][:2]
            assert gone == {1000, second} or gone == {1000}, gone
        elif name == "near_duplicates":
            assert gone == {1002}
        else:
            assert gone == {1003}
        docs = spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r[0] for r in packed.select("doc_id").collect()} == kept


def test_repeated_rows_go_with_the_copies(spark):
    rows = [(1, "a b", 1), (1, "a b", 1), (1, "a  b", 2), (1, "other", 1), (2, "ab", 1), (None, "ab", 1), (3, None, 1), (4, "", 1)]
    out = corpus_pipeline.exact_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "")
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([(1, "a  b", 2), (1, "other", 1), (3, None, 1)], key=str)


def test_run_and_names(spark, tables):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    rows = corpus_pipeline.run(spark, tables[0])
    assert rows.count() > 400 and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)


def test_registered():
    import __spark_entry__ as entry

    q = entry.queries()
    assert [n for n in range(1, 11) if any(k.startswith(f"op{n}_") for k in q)] == list(range(1, 11)) and "pipeline" in q
    assert set(entry.oracle_sql()) <= set(q)


CLASHING = "doc_id long, text string, _sha string, _place int, _row int, _kept_id int, _chosen_id int, rows int, gone int, sender int, node long"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, tables, name):
    stage, rnd = dict(corpus_pipeline.STAGES)[name], random.Random(3)
    words = lambda n: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(6)) for _ in range(n))
    texts = [words(40), words(30), None, "", words(50), words(20)]
    rows = [(i, t, f"s{i}", *range(i or 0, (i or 0) + 8)) for i, t in zip([1, 1, 2, 3, None, None], texts, strict=True)]
    docs = spark.createDataFrame(rows, CLASHING)
    out = stage(spark, docs, tables[0])
    assert out.columns == docs.columns and out.schema == docs.schema
    gone = {"exact_dedup": 1}.get(name, 0)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) - gone and set(got) <= set(rows)
    assert stage(spark, docs.limit(0), tables[0]).collect() == []


def test_run_against_brute_force(spark, tables):
    """Which documents reach the packing, by plain Python from the documents that the classifier leaves."""
    import re

    d, texts = tables
    out = corpus_pipeline.run(spark, d)
    packed = {r[0] for r in out.select("doc_id").collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = {r[0] for r in corpus_pipeline.toxic_stage(spark, docs, d).select("doc_id").collect()}
    first = {}
    for i in sorted(left, key=lambda i: (-len(texts[i] or ""), i)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i] or ""), i)
    kept = sorted(first.values())
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i in kept for w in [(texts[i] or "").lower().split()]}
    near = [i for i in kept if not any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0 for j in kept)]
    items = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {i for i in near if not any(t.lower() in (texts[i] or "").lower() for t in items)}
    assert packed == clean and len(clean) > 400
    assert {tuple(r) for r in out.groupBy("doc_id").sum("length").collect()} == {(i, n) for i, n in packed_lengths(texts, clean)}


def packed_lengths(texts, ids):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(i, len(tk.encode(texts[i] or "", add_special_tokens=False).ids) + 1) for i in ids]
