"""Notices, test items and stages that once did less than the whole job, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hustings.llm import decontaminate, license_scan


def fewest_edits(text, phrase):
    """Of every run of whole words the edits to the phrase, by the plain table: {(start, end): edits}."""
    out = {}
    for a in range(len(text)):
        if a and text[a - 1] != 32:
            continue
        row = list(range(len(phrase) + 1))
        for b in range(a, min(len(text), a + len(phrase) + 10)):
            new = [b - a + 1]
            for j, c in enumerate(phrase):
                new.append(min(row[j] + (text[b] != c), row[j + 1] + 1, new[-1] + 1))
            row = new
            if b + 1 == len(text) or text[b + 1] == 32:
                out[a, b + 1] = row[-1]
    return out


@pytest.mark.parametrize("notice", [n for n in license_scan.FUZZY if n.edits], ids=lambda n: n.phrase[:20])
def test_repeated_notices_are_all_found(notice):
    rnd = random.Random(3)
    for edited in ((), (0,), (1,), (0, 2), (0, 1, 2)):
        copies = []
        for k in range(3):
            s = list(notice.phrase)
            for i in rnd.sample([i for i in range(2, len(s) - 2) if s[i] != " "], notice.edits if k in edited else 0):
                s[i] = "q"
            copies.append("".join(s).encode())
        for text in (b" ".join(copies), b"so " + b" and ".join(copies) + b" end"):
            got = license_scan.find(text, notice)
            scores = fewest_edits(text, notice.phrase.encode())
            assert len(got) == 3 and all(scores[s, e] == n for s, e, n in got), (text, got)
            # no run of words that overlaps one found notice only is closer
            for (a, b), v in scores.items():
                near = [n for s, e, n in got if a < e and s < b]
                assert len(near) != 1 or near[0] <= v


def test_short_benchmark_items_are_found(spark):
    items = [(1, "Forty-two"), (2, "Paris."), (3, "who wrote it"), (4, "Name it. Oslo"), (5, "forty two"), (6, "to be or not to be that is"), (7, None)]
    docs = [(10, "the answer is forty two, he said"), (11, "PARIS"), (12, "forty and two; who wrote that"), (13, "so name it: oslo"), (14, "well to be or not to be that is"), (15, None), (16, "parish"), (17, "end name it"), (18, "oslo who wrote"), (19, "it paris")]
    made = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["overlap"], r["question_overlap"], r["answer_overlap"]) for r in decontaminate.contaminated(*made).collect()}
    assert set(got) == {(10, 1), (10, 5), (11, 2), (13, 4), (14, 6), (19, 2)}
    assert got[10, 1] == (1.0, 1.0, None) and got[13, 4] == (1.0, None, 1.0)
    assert {r["doc_id"]: r["n_items"] for r in decontaminate.decontaminate(*made).collect() if r["contaminated"]} == {10: 2, 11: 1, 13: 1, 14: 1, 19: 1}


def test_scores_are_the_same_in_shards(spark, monkeypatch):
    rnd = random.Random(4)
    common = [" ".join(f"c{rnd.randrange(40)}" for _ in range(12)) for _ in range(4)]
    items = [(k, f"{rnd.choice(common)} " + " ".join(f"i{k}x{j}" for j in range(rnd.randrange(3, 25)))) for k in range(40)] + [(77, "two words"), (78, None)]
    docs = [(k, " ".join(rnd.choice(items[:40])[1].split()[a : a + 14])) for k in range(60) for a in [rnd.randrange(9)]]
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = []
    for size in (1 << 20, 600):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        got.append(sorted(tuple(r) for r in decontaminate.contaminated(*made).select("doc_id", "item_id", F.round("bm25", 9), "overlap").collect()))
    assert len(got[0]) > 20 and got[0] == got[1]


@pytest.mark.parametrize("stage", ["toxicity", "decontamination"])
def test_rows_that_share_a_doc_id_go_by_their_texts(spark, tmp_path, monkeypatch, stage):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    bad = "one two three four five six seven eight"
    rows = [(None, bad, "a"), (None, "clean", "b"), (None, None, "c"), (5, "fine", "d"), (5, bad, "e"), (5, bad, "f"), (6, bad, "g"), (7, "good", "h"), (8, "twice", "i"), (8, "twice", "i")]
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "toxicity", lambda docs, model: docs.select("doc_id", F.when(F.col("text") == bad, 1).otherwise(0).alias("predicted")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert out.schema == docs.schema and sorted(map(str, out.collect())) == sorted(map(str, docs.filter("text IS NULL OR text NOT LIKE 'one two%'").collect()))


def test_question_and_answer_must_both_stand(spark):
    question, answer = " ".join(f"q{k}" for k in range(60)) + ".", " ".join(f"a{k}" for k in range(9))
    items = [(1, f"{question} {answer}"), (2, " ".join(f"o{k}" for k in range(30)))]
    docs = [(10, f"so {question} {answer} end"), (11, f"so {question} another answer stands here at the end"), (12, f"only {answer} without what was asked"), (13, items[1][1])]
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["overlap"] for r in decontaminate.contaminated(*made).collect()}
    # the question alone is most of the item
    assert found[11, 1] >= decontaminate.OVERLAP
    rows = decontaminate.decontaminate(*made).collect()
    assert {r["doc_id"]: r["contaminated"] for r in rows} == {10: True, 11: False, 12: False, 13: True}
    assert {r["doc_id"] for r in decontaminate.contaminated(*made).filter(decontaminate.verified()).collect()} == {10, 13}


def test_decontaminate_against_brute_force(spark):
    """Every pair of document and item by its shingles alone, without an index."""
    rnd = random.Random(11)
    item = lambda: " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(60)) for _ in range(rnd.randrange(6, 40))) + rnd.choice(["", ". " + " ".join(f"z{rnd.randrange(90)}" for _ in range(7))])
    items = [(k, item()) for k in range(30)]
    docs = []
    for k in range(120):
        w = [f"f{rnd.randrange(400)}" for _ in range(rnd.randrange(0, 200))]
        for _, t in rnd.sample(items, rnd.randrange(0, 3)):
            own = t.split()
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(len(own))] = "edited"
            a, at = rnd.randrange(0, 3), rnd.randrange(len(w) + 1)
            w[at:at] = own[a:]
        docs.append((k, rnd.choice([" ", "\n", ", "]).join(w)))

    def runs(text):
        w = re.findall(r"[0-9a-z]+", text.lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for i, t in items:
        every, asked = runs(t), len(re.findall(r"[0-9a-z]+", decontaminate.split_answer(t)[0].lower()))
        where = {}
        for nth, x in enumerate(every):
            where.setdefault(x, nth + 5 > asked)
        for d, text in docs:
            has = set(runs(text))
            share = lambda kind: (lambda own: sum(x in has for x in own) / len(own) if own else 1.0)([x for x, tail in where.items() if kind is None or tail == kind])  # noqa: B023, E731
            if min(share(None), share(False), share(True)) >= decontaminate.OVERLAP:
                want[d, i] = round(share(None), 9)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).filter(decontaminate.verified()).collect()
    assert len(want) > 30 and {(r["doc_id"], r["item_id"]): round(r["overlap"], 9) for r in got} == want
