import hashlib
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from hustings.llm import components, decontaminate, encode, exact_dedup, jaccard_join, license_scan, packing, quality, queries, secret_scan, simple8b, suffix_dedup, textops, token_files, toxicity
from hustings.llm.labelled import training_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def by_id(df, *more):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, *[r[m] for m in more]))


def test_every_operator_takes_an_empty_table(none, spark, tmp_path):
    assert suffix_dedup.suffix_dedup(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0 and jaccard_join.jaccard_join(none).count() == 0
    assert license_scan.license_scan(none).count() == 0 and secret_scan.secret_scan(none)[0].count() == 0 and packing.pack_documents(none, BYTE).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, bench).count() == 0
    token_files.write_token_files(none, str(tmp_path / "t"), WORD, 2)
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(none, toxicity.fit(none, labels)).count() == 0 and quality.quality(none, quality.fit(none, labels)).count() == 0


# 1 -------------------------------------------------------------------------------------------------------------


def cut_by_hand(texts, width=100):
    seen, out = set(), []
    for _, t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                gone[p : p + width] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, texts):
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter((i, *x) for (i, _), x in zip(texts, cut_by_hand(texts), strict=True))


def test_suffix_dedup_deals_hot_anchors_by_window(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "answer", _all_hot())
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) == Counter((i, x[1]) for (i, _), x in zip(texts, cut_by_hand(texts), strict=True))


def _all_hot():
    """Answers that call every shared anchor hot; a nested function, so that workers get it by value."""

    def run(table):
        from hustings.llm import suffix_dedup as module

        out = module.answer(table)
        return out.set_column(out.schema.get_field_index("hot"), "hot", out["shared"])

    run.__module__ = "__main__"
    return run


def test_index_family_is_logarithmic_and_exact():
    rnd = random.Random(2)
    alphabet = [bytes(rnd.choice(b"abcd") for _ in range(40)) for _ in range(12)]
    family, seen, expected, at = suffix_dedup.IndexFamily(), set(), 0, 0
    for doc in range(40):
        data = b"".join(rnd.choice(alphabet) for _ in range(8))
        raw = np.frombuffer(data, np.uint8)
        a, first, last = suffix_dedup.anchors(raw, np.array([0, len(raw)]))
        key = np.arange(at, at + len(a))
        at += len(a)
        family.add(suffix_dedup.entries(suffix_dedup.padded(raw), a + suffix_dedup.PAD, a - last, a - first, np.full(len(a), doc), a, key))
        for p in range(len(data) - 99):
            expected += data[p : p + 100] not in seen
            seen.add(data[p : p + 100])
        assert len(family.levels) <= 8
    assert int(family.all().live.sum()) == expected


def test_many_senders_are_compared_in_few_batches(monkeypatch):
    """A bucket's senders grow with the input; a scan of all levels for each of them would grow with its square."""
    added, add = [], suffix_dedup.IndexFamily.add
    monkeypatch.setattr(suffix_dedup.IndexFamily, "add", lambda self, batch: (added.append(len(batch)), add(self, batch))[1])
    monkeypatch.setattr(suffix_dedup, "BATCH", 100)
    senders, passage = 250, np.frombuffer(bytes(range(100)), np.uint8)
    blobs = [zstandard.compress(np.array([1, s, 7], "<i8").tobytes() + bytes(2) + passage.tobytes()) for s in range(senders)]
    table = pa.table([pa.array([0] * senders, pa.int32()), pa.array(range(senders), pa.int32()), pa.array([False] * senders), pa.array(blobs, pa.binary())], names=["bucket", "sender", "done", "blob"])
    out = suffix_dedup.compare(table)
    marks = {s: np.frombuffer(zstandard.decompress(b), "<i8").tolist() for s, b in zip(out["sender"].to_pylist(), out["blob"].to_pylist(), strict=True)}
    assert marks == {s: [s, 7, 7] for s in range(1, senders)} and added == [100, 100, 50]


def test_answer_tells_each_sender_what_is_shared(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    have = {4: [1, 5, 9], 2: [5, 9, 70], 7: [9], 1: [8]}
    rows = [(3, s, len(x), *exact_dedup.rice_encode(np.array(x, np.uint64))) for s, x in have.items()]
    out = suffix_dedup.answer(pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["owner", "sender", "n", "k", "blob"]))
    for i, (s, x) in enumerate(have.items()):
        got = [np.unpackbits(np.frombuffer(zstandard.decompress(out[name][i].as_py()), np.uint8))[: len(x)].tolist() for name in ("shared", "hot")]
        assert out["sender"][i].as_py() == s and got == [[int(v in (5, 9)) for v in x], [int(v == 9) for v in x]]


# 2 -------------------------------------------------------------------------------------------------------------


def test_license_scan(docs, texts):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for i, t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    got = license_scan.license_scan(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter(want)
    fuzzy = [r for r in got if r["n_base"] == 0 and r["labels"] == "mit"]
    assert len(fuzzy) == 1 and 0.9 < fuzzy[0]["score"] < 1 and all(0 <= r["score"] <= 1 for r in got)


def test_seeds_miss_no_edited_notice():
    rnd = random.Random(1)
    for notice in license_scan.FUZZY:
        for _ in range(12):
            s = list(notice.phrase)
            for _ in range(notice.edits):
                k = rnd.randrange(1, len(s) - 1)
                if s[k] != " ":
                    s[k] = "q"
            text = ("some words before " + "".join(s) + " and after").encode()
            assert license_scan.find(text, notice), "".join(s)


# 3 and encoding ------------------------------------------------------------------------------------------------


def reference_ids(path, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    return [np.array(e.ids, "<u4") for e in tk.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_is_the_library(path, texts):
    rnd = random.Random(4)
    parts = ["a", "Bc", "é", "İ", "ß", "1", "٣", " ", "  ", "\n", "\n\n", "\t", "'s", "́", ".", ",", "$$", "_", "'", "日", "\x1c", "\x85", "​", "The", "<|endoftext|>"]
    many = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + [t for _, t in texts]
    rnd.shuffle(parts)
    many += [a + special + b for special in ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|") for a in ("", "hello ", "x", "a \n", "é  ") for b in ("", " world", "y", "\n\nb", "<|endoftext|>")]
    got = encode.Encoder(path).encode(many)
    assert sum(b"<|endoftext|>" in t.encode() for t in many) > 50
    assert got == [x.tobytes() for x in reference_ids(path, many)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_of_digits_like_letters_and_of_case(path, monkeypatch):
    many = ["10 m\u00b2, x\u00bd! a\u00b9.", "m\u00b2,", "\u023ab \u023e, \u212a", "\u00aab, \u00ba.", "Stra\u00dfe STRASSE, \u00c9T\u00c9"]
    assert encode.Encoder(path).encode(many) == [x.tobytes() for x in reference_ids(path, many)]
    enc = encode.Encoder(path)
    asked, tokenize = [], enc.tokenize
    enc.tokenize = lambda w: asked.append(w) or tokenize(w)
    cased = ["a Shell shell SHELL, \u00c9t\u00e9 \u00e9t\u00e9 \u00c9T\u00c9"]
    assert enc.encode(cased) == [x.tobytes() for x in reference_ids(path, cased)]
    # a vocabulary without capitals is asked once for words that differ in case
    assert len(asked) == (3 if enc.kind == "worded" else 7)


def test_packing_encodes_a_kept_piece_once(docs, spark, monkeypatch):
    # the query keeps as many pieces as the token files do, and how many are kept changes no rows
    got = {}
    pack = packing.pack_documents
    monkeypatch.setattr(packing, "pack_documents", lambda *a, **k: got.update(k) or pack(docs, *a[1:], **k))
    monkeypatch.setattr(queries, "table", lambda *a: docs)
    of = lambda df: sorted(df.select("doc_id", "piece", "start", "length", "ids_crc32").collect(), key=str)
    assert of(queries.op10_packing(spark, "")) == of(pack(docs, BYTE, kept=3)) and got["kept"] == token_files.KEPT > encode.KEPT


def test_simple8b_round_trips():
    rng = np.random.default_rng(0)
    for k in (0, 1, 5, 59, 1000, 70_000):
        for high in (1, 2, 300, 50_000, 2**32):
            v = rng.integers(0, high, k, dtype=np.uint64)
            v[rng.random(k) < 0.03] = 2**32 - 1
            words, escapes = simple8b.pack(v)
            assert (simple8b.unpack(words, escapes, k) == v).all()
    assert len(simple8b.pack(np.zeros(6000, np.uint64))[0]) == 100
    ids, ends, back = simple8b.read_block(simple8b.block(np.array([7, 9]), np.array([2, 1]), np.array([5, 6, 7])))
    assert ids.tolist() == [7, 9] and ends.tolist() == [2, 3] and back.tolist() == [5, 6, 7]
    with pytest.raises(ValueError, match="not a Simple-8b"):
        simple8b.read_block(b"x" * 40)


def test_token_files(docs, spark, texts, tmp_path):
    token_files.write_token_files(docs, str(tmp_path / "t"), WORD, 2, shards=3)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    ids = [np.append(x, 2).astype("<u4") for x in reference_ids(WORD, [t for _, t in texts])]
    starts = np.cumsum([0, *map(len, ids)])
    assert [r["doc_id"] for r in got] == [i for i, _ in texts] and [r["start"] for r in got] == starts[:-1].tolist()
    assert Counter((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got) == Counter((i, zlib.crc32(x.tobytes()), len(x)) for (i, _), x in zip(texts, ids, strict=True))


def test_token_files_of_extreme_ids(spark, tmp_path):
    rows = [(-(2**63), "least"), (2**63 - 1, "largest"), (None, "none"), (None, ""), (0, None)]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), WORD, 2, shards=2)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -(2**63), 0, 2**63 - 1] and sorted(r["n_tokens"] for r in got) == [1, 1, 2, 2, 2]


# 4 and 9 -------------------------------------------------------------------------------------------------------


def labelled(spark, bad, column, modulus, remainder):
    """Documents that a marker (or a look) tells apart, with labels, and what is held out."""
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        y = i % 4 == 0
        text = " ".join(rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(20, 160)))
        rows.append((i, bad(text, rnd) if y else text))
        labels.append((i, int(y) if column == "toxic" else int(not y)))
    docs = spark.createDataFrame([*rows, (None, "nobody"), (5000, None), (5001, "")], "doc_id long, text string").withColumn("label", F.lit(9)).withColumn("lang", F.lit("x"))
    return docs, spark.createDataFrame([*labels, (None, 1), (7000, None)], f"doc_id long, {column} int"), dict(labels)


def accuracy(rows, labels, modulus, remainder):
    out = defaultdict(list)
    for r in rows:
        if r["doc_id"] in labels:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
            out[r["held_out"]].append((r["predicted"] == 1) == (labels[r["doc_id"]] == 1))
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    return np.mean(out[True])


def test_toxicity_on_held_out_rows(spark):
    def bad(text, rnd):
        w = text.split()
        w.insert(rnd.randrange(len(w)), rnd.choice(["grobnak", "grobnakium", "vilestuff"]))
        return " ".join(w)

    docs, labels, truth = labelled(spark, bad, "toxic", 4, 2)
    model = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(docs, model).collect()
    assert len(rows) == 903 and accuracy(rows, truth, 4, 2) > 0.93
    again = toxicity.toxicity(docs.repartition(5), toxicity.fit(docs.repartition(5), labels)).collect()
    # training sums floats, whose last digits may differ from run to run; decisions hold
    decided = lambda rs: {r["doc_id"]: r["predicted"] for r in rs}
    first, second = decided(rows), decided(again)
    assert np.mean([first[k] == second[k] for k in first]) > 0.97


def test_toxicity_learns_from_all_labelled_rows(spark):
    """More rows than one task learns from: each has its part in a pass, and the averaged models tell labels as well."""
    docs, labels, truth = labelled(spark, lambda text, rnd: text + " " + rnd.choice(["grobnak", "grobnakium", "vilestuff"]), "toxic", 4, 2)
    more = [F.col("doc_id") + 10_000 * i for i in range(6)]
    many = lambda df: df.filter("doc_id < 900").withColumn("doc_id", F.explode(F.array(*more)))
    rows = toxicity.toxicity(docs, toxicity.fit(many(docs), many(labels), alone=2500)).collect()
    assert len(rows) == 903 and accuracy(rows, truth, 4, 2) > 0.93
    assert training_rows(labels, "toxic", 4, 2).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in truth)


def test_a_pass_of_trainers_is_their_average():
    order = np.linspace(-(1 << 63), (1 << 63) - 1025, 50).astype(np.int64)
    parts = [pa.RecordBatch.from_arrays([pa.array([f"{w} word{i} ok" for i in range(50)]), pa.array([i % 2 for i in range(50)], pa.int32()), pa.array(order)], ["text", "label", "order"]) for w in ("good", "bad")]
    m = toxicity._begin(np.random.default_rng(7))
    state = pickle.dumps((m, toxicity._squares(m)))
    told = [b for p in parts for b in toxicity._one_pass(state, 0.5, 0)(iter([p]))]
    assert [b["rows"][0].as_py() for b in told] == [int((order < toxicity.KEPT_BACK).sum())] * 2 and 39 <= told[0]["rows"][0].as_py() <= 41
    mean = {b["chunk"][0].as_py(): b for b in toxicity._averages(iter(told))}
    alone = [{b["chunk"][i].as_py(): (b["ids"][i].as_py(), b["change"][i].as_py()) for i in range(b.num_rows)} for b in told]
    assert set(mean) == set(alone[0]) | set(alone[1])
    dense = [np.frombuffer(a[-1][1], np.float64) for a in alone]
    assert np.allclose(np.frombuffer(mean[-1]["change"][0].as_py(), np.float64), (dense[0] + dense[1]) / 2)
    for chunk in set(mean) - {-1}:
        want = defaultdict(list)
        for a in alone:
            if chunk in a:
                for i, v in zip(np.frombuffer(a[chunk][0], "<u2"), np.frombuffer(a[chunk][1], "<f4").reshape(-1, toxicity.DIM + 1), strict=True):
                    want[int(i)].append(v)
        ids = np.frombuffer(mean[chunk]["ids"][0].as_py(), "<u2").tolist()
        assert ids == sorted(want)
        assert np.allclose(np.frombuffer(mean[chunk]["change"][0].as_py(), "<f4").reshape(-1, toxicity.DIM + 1), [np.mean(want[i], axis=0) for i in ids], atol=1e-6)


def test_pooling_covers_the_whole_text():
    rng = np.random.default_rng(1)
    m = toxicity.train([np.ones((5, toxicity.TABLES), np.uint16)] * 4, np.array([0, 1, 0, 1]), np.zeros(4, int), epochs=1)
    rows = rng.integers(1, 1000, (300_000, toxicity.TABLES)).astype(np.uint16)
    starts = np.array([0, 10, 131_000, 131_072, 299_990])
    got = m.pooled(rows, starts)
    answers = m.answers(m.embed(rows))
    want = np.maximum(np.stack([answers[a:b].max(axis=0) for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)]), 0)
    assert np.allclose(got, want, atol=1e-5)


def test_quality_on_held_out_rows(spark):
    def bad(text, rnd):
        return " ".join(w + "$$$" for w in text.split()) if rnd.random() < 0.5 else (text.upper().split(" ")[0] + "!! ") * 60

    docs, labels, truth = labelled(spark, bad, "quality", 5, 0)
    rows = quality.quality(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 903 and accuracy(rows, truth, 5, 0) > 0.97


# 5 -------------------------------------------------------------------------------------------------------------


def shingles(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def components_by_hand(texts, words=4, percent=85):
    sets = [shingles(t, words) for _, t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(d, len(sets[k]), texts[find(k)][0]) for k, (d, _) in enumerate(texts)]


def near_copies(n, edits, seed=3):
    rnd = random.Random(seed)
    base = [f"t{i}" for i in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(1000)}"
        out.append((100 + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, texts, words, percent):
    got = jaccard_join.jaccard_join(docs, words, percent).collect()
    known = [(i, t) for i, t in texts if i is not None]
    want = Counter(components_by_hand(known, words, percent)) + Counter([(None, 1, None)])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("edits", [3, 9])
def test_jaccard_join_of_a_large_group(spark, edits, monkeypatch):
    for name, value in (("LIST", 5), ("HOT", 12), ("BLOCK", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies(140, edits) + [(i, t.replace("t1", "z1")) for i, t in near_copies(40, edits, 8)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_by_hand(rows)


def test_answers_from_answers_lose_nothing():
    rnd = random.Random(6)
    base = list(range(100))
    sets = []
    for _ in range(60):
        s = set(base)
        for _ in range(rnd.randint(0, 12)):
            s.discard(rnd.choice(base))
            s.add(rnd.randrange(1000, 2000))
        sets.append(np.array(sorted(s), np.uint64))
    d = lambda a, b: 1 - len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    pivot = np.array([d(s, sets[0]) for s in sets])
    links = jaccard_join.join_block(sets, np.zeros(60, int), pivot <= 0.15, pivot, 85)
    root = list(range(60))
    inside = [i for i in range(60) if pivot[i] <= 0.15]
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in [*links, *((inside[0], x) for x in inside)]:
        root[find(a)] = find(b)
    for i in range(60):
        for j in range(i):
            if d(sets[i], sets[j]) <= 0.15:
                assert find(i) == find(j)
    assert all(d(sets[i], sets[j]) <= 0.15 for i, j in links)


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + rnd.randrange(80), 5000 + rnd.randrange(80)) for _ in range(60)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect())
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------


def test_wand_is_exact():
    rnd = random.Random(3)
    items = [(i, " ".join(f"v{rnd.randrange(12)}" for _ in range(rnd.randint(5, 30)))) for i in range(150)]
    index = decontaminate.build(items)
    for _ in range(60):
        terms = np.array(sorted(rnd.sample(range(len(index.terms)), min(len(index.terms), rnd.randint(1, 40)))))
        scores = np.zeros(len(items))
        for t in terms:
            s = slice(index.starts[t], index.starts[t + 1])
            scores[index.places[s]] += index.scores[s]
        assert sorted(i for i, _ in decontaminate.wand(index, terms)) == np.flatnonzero(scores >= 1 - 1e-9).tolist()


def test_decontaminate(spark, docs, texts):
    rnd = random.Random(8)
    items = [(k, " ".join(f"q{rnd.randrange(500)}" for _ in range(30)) + ". " + " ".join(f"a{rnd.randrange(500)}" for _ in range(10))) for k in range(30)] + [(98, "too short"), (99, None)]
    filler = lambda n: " ".join(f"w{rnd.randrange(900)}" for _ in range(n))
    more = [(1000, filler(300) + " " + items[3][1].upper() + " " + filler(300)), (1001, filler(50) + " " + " ".join(items[4][1].split()[:12])), (1002, items[5][1]), (1003, filler(62) + " " + items[6][1] + "\n" + items[7][1])]
    long_ = " ".join(f"l{rnd.randrange(5000)}" for _ in range(400))
    items.append((100, long_))
    more.append((1004, filler(10) + " " + long_ + " " + filler(10)))
    bench = spark.createDataFrame([*items, (None, filler(20))], "item_id long, text string")
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = decontaminate.decontaminate(every, bench).collect()
    assert len(rows) == len(texts) + len(more)
    got = {r["doc_id"]: (r["n_items"], r["item_id"]) for r in rows if r["contaminated"]}
    assert got == {1000: (1, 3), 1002: (1, 5), 1003: (2, 6), 1004: (1, 100)}
    part = next(r for r in rows if r["doc_id"] == 1000)
    assert part["question_overlap"] == 1.0 and part["answer_overlap"] == 1.0


def test_decontaminate_in_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 300)
    items = [(k, " ".join(f"s{k}x{j}" for j in range(20))) for k in range(12)]
    docs = spark.createDataFrame([(k, "before " + t) for k, t in items] + [(50, "clean text")], "doc_id long, text string")
    rows = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item_id"] for r in rows if r["contaminated"]} == {k: k for k, _ in items}


# 7 -------------------------------------------------------------------------------------------------------------


def test_rice_coding_round_trips():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 5000):
        for top in (60, 2**20, 2**63):
            v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            k, blob = exact_dedup.rice_encode(v)
            assert (exact_dedup.rice_decode(len(v), k, blob) == v).all()


def test_exact_dedup(docs, texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is not None, i or 0, i))
    want = Counter()
    for norm, members in groups.items():
        keep = min(members)
        for k, m in enumerate(sorted(members)):
            want[m[3], keep[3], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


# 8 -------------------------------------------------------------------------------------------------------------


def spans_by_hand(t):
    out = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_scan(docs, texts):
    want = Counter()
    for i, t in texts:
        found = spans_by_hand(t)
        kinds = Counter(x[2] for x in found)
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
        want[i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(text.encode()).hexdigest()] += 1
    got = secret_scan.digest(secret_scan.secret_scan(docs)[0]).collect()
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    assert any("forge:" in r["spans"] for r in got)


def test_ledger_scans_only_what_is_new(docs, spark):
    first, new = secret_scan.secret_scan(docs)
    again = secret_scan.unseen(secret_scan.blobs(docs)[1], secret_scan.RULES, new.seen)
    assert again.count() == 0
    raised = tuple(secret_scan.Rule(r.kind, r.pattern, r.group, r.least, 2 if r.kind == "hex" else 1, r.base) for r in secret_scan.RULES)
    todo = secret_scan.unseen(secret_scan.blobs(docs)[1], raised, new.seen)
    assert {r["rules"] for r in todo.collect()} == {1 << 2}
    later, more = secret_scan.secret_scan(docs, raised, new)
    assert sorted(map(str, secret_scan.digest(later, raised).collect())) == sorted(map(str, secret_scan.digest(first).collect()))
    assert {r["rule"] for r in more.findings.collect()} == {"hex"}


def test_history_scans_each_content_once(spark, docs, tmp_path, monkeypatch):
    """Through the folder: a version that comes again, in part or whole, brings nothing that is scanned."""
    asked, plain = [], secret_scan.scan
    monkeypatch.setattr(secret_scan, "scan", lambda todo, rules=secret_scan.RULES: (asked.append(todo.count()), plain(todo, rules))[1])
    rows = lambda found: sorted(map(str, secret_scan.digest(found).collect()))
    want = rows(secret_scan.secret_scan(docs)[0])
    asked.clear()
    path = str(tmp_path / "ledger")
    parts = [docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 1"), docs, docs]
    assert rows(secret_scan.scan_history(parts, path)) == want
    texts = docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().count()
    assert sum(asked) == texts and asked[3] == 0 and asked[2] < texts
    # findings come from the ledger alone when nothing is new; a run that was lost before its pairs were noted counts once
    ledger = secret_scan.Ledger.read(spark, path)
    ledger.findings.write.mode("append").parquet(f"{path}/findings")
    assert rows(secret_scan.scan_history([docs], path)) == want and ledger.seen.count() == texts * len(secret_scan.RULES)


# 10 ------------------------------------------------------------------------------------------------------------


def test_packing(docs, texts):
    rows = packing.pack_documents(docs, BYTE, 2, 128).collect()
    ids = [np.append(x, 2).astype("<u4") for x in reference_ids(BYTE, [t for _, t in texts])]
    want = Counter()
    for (i, _), x in zip(texts, ids, strict=True):
        cuts = [0, *range(len(x) % 128 or 128, len(x) + 1, 128)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(x[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(len(x) for x in ids)
    assert len(bins) <= -(-total // 128) * 1.05 + 2


def test_fullest_is_the_best_subset():
    rnd = random.Random(2)
    for _ in range(200):
        counts = {rnd.randint(1, 20): rnd.randint(1, 3) for _ in range(rnd.randint(0, 6))}
        room = rnd.randint(0, 40)
        reach = {0}
        for n, c in counts.items():
            reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= room}
        taken = packing.fullest(counts, room)
        assert sum(n * c for n, c in taken.items()) == max(reach) and all(c <= counts[n] for n, c in taken.items())


# shared --------------------------------------------------------------------------------------------------------


def test_word_hashes_and_shingles():
    column = pa.array(["The the THE x", None, "", "a b c d e", "é É"])
    data, off = textops.text_bytes(column)
    start, end, doc = textops.word_bounds(data, off, textops.NOT_SPACE)
    h = textops.word_hashes(data, start, end)
    assert h[0] == h[1] == h[2] != h[3] and doc.tolist() == [0] * 4 + [3] * 5 + [4] * 2 and h[-1] != h[-2]
    s, d = textops.shingle_hashes(h, doc, 4, 5)
    assert d.tolist() == [0, 3, 3, 4]
    parts = list(textops.steps(iter([pa.RecordBatch.from_arrays([column], ["text"])]), most=4))
    assert sum(p[0].num_rows for p in parts) == 5


def test_most_common_shingles_are_chosen_without_a_sort(spark):
    rnd = random.Random(1)
    rows = [(rnd.getrandbits(63), n) for n, m in [(5000, 3), (90, 10), (7, 900), (2, 800)] for _ in range(m)]
    counted = spark.createDataFrame(rows, "shingle long, n long")
    got = lambda most: Counter(r["n"] for r in jaccard_join._most_common(counted, most).collect())
    assert got(5000) == Counter(n for _, n in rows) and got(13) == {5000: 3, 90: 10}
    part = got(400)
    assert part[5000] == 3 and part[90] == 10 and 300 < part[7] < 470 and 2 not in part
    assert got(1)[5000] <= 1 and jaccard_join._most_common(counted.limit(0), 10).count() == 0


def toxic_logit_by_hand(m, rows):
    """The classifier's answer for one document's rows of words, in plain Python."""
    reach, z = max(toxicity.WIDTHS) - 1, []
    embed = [[float(x) for t in range(toxicity.TABLES) for x in m.tables[t, r[t]]] for r in rows] + [[0.0] * toxicity.TABLES * toxicity.DIM] * (2 * reach)
    for k, w in enumerate(m.filters):
        for f in range(toxicity.FILTERS):
            spots = [sum(x * float(w[j, i, f]) for j in range(len(w)) for i, x in enumerate(embed[p + j])) for p in range(len(rows) + reach)]
            z.append(max(0.0, max(spots) + float(m.bias[k * toxicity.FILTERS + f])))
    return sum(a * float(b) for a, b in zip(z, m.out, strict=True)) + m.base


def test_toxicity_is_the_forward_pass_of_each_document_alone():
    rng = np.random.default_rng(4)
    m = toxicity.train([rng.integers(1, 500, (6, toxicity.TABLES)).astype(np.uint16) for _ in range(8)], np.array([0, 1] * 4), np.zeros(8, int), epochs=1)
    m.bias[:] = rng.normal(-0.2, 0.3, len(m.bias))
    m.out[:] = rng.normal(0, 1, len(m.out))
    m.tables[:, 1:] *= 6
    docs = [rng.integers(1, 500, (n, toxicity.TABLES)).astype(np.uint16) for n in (0, 1, 2, 3, 0, 0, 7, 1)]
    want = [toxic_logit_by_hand(m, d) for d in docs]
    rows, starts = toxicity.laid_out(np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), len(docs))
    assert np.allclose(m.logits(rows, starts), want, atol=1e-4)
    # whatever stands beside it
    back = docs[::-1]
    rows, starts = toxicity.laid_out(np.concatenate(back), np.repeat(np.arange(len(back)), [len(d) for d in back]), len(back))
    assert np.allclose(m.logits(rows, starts), want[::-1], atol=1e-4)


def test_toxicity_embeds_a_word_once_however_often_it_stands(monkeypatch):
    rng = np.random.default_rng(5)
    m = toxicity.train([rng.integers(1, 500, (6, toxicity.TABLES)).astype(np.uint16) for _ in range(8)], np.array([0, 1] * 4), np.zeros(8, int), epochs=1)
    texts, seen, embed = [" ".join(rng.choice(["alpha", "Alpha", "beta", "gamma", "deltas"], 400)) for _ in range(50)] + ["", "--"], [], toxicity.Model.embed
    monkeypatch.setattr(toxicity.Model, "embed", lambda self, rows: seen.append(len(rows)) or embed(self, rows))
    score = lambda ts: np.concatenate([b["score"].to_numpy() for b in toxicity._score(m)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(ts))), pa.array(ts), pa.array([False] * len(ts))], ["doc_id", "text", "held_out"])]))])
    got = score(texts)
    # four words, as case doesn't count, and padding; 20,000 words and more stand there
    assert sum(seen) == 5 and np.allclose(got, np.concatenate([score([t]) for t in texts]), atol=1e-6)
    # so does training, whose gradient sums are of 16 documents
    seen.clear()
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(52)], pa.int32()), pa.array(range(52))], ["text", "label", "order"])
    told = list(toxicity._one_pass(pickle.dumps((m, toxicity._squares(m))), 0.5, 0)(iter([batch])))
    assert told[0]["rows"][0].as_py() == 52 and max(seen) <= 5


def quality_logit_by_hand(m, passages):
    import math

    w = {k: v.astype(float) for k, v in m.weights.items()}
    hidden, raw = [], []
    for x in passages:
        z = [min(8.0, max(-8.0, (float(a) - float(b)) / float(c))) for a, b, c in zip(x, m.mean, m.scale, strict=True)]
        h = [math.tanh(sum(z[i] * w["encode"][i, j] for i in range(len(z))) + w["encode0"][j]) for j in range(w["encode"].shape[1])]
        raw.append(sum(math.tanh(sum(h[i] * w["see"][i, j] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * w["gate"][i, j] for i in range(len(h))))) * w["attend"][j] for j in range(len(w["attend"]))))
        hidden.append(h)
    e = [math.exp(r - max(raw)) for r in raw]
    whole = [sum(a / sum(e) * h[j] for a, h in zip(e, hidden, strict=True)) for j in range(len(hidden[0]))]
    return sum(a * b for a, b in zip(whole, w["out"], strict=True)) + w["out0"][0]


def test_quality_is_the_forward_pass_and_learns_by_its_gradient():
    rng = np.random.default_rng(5)
    bags = [rng.normal(0, 1, (n, quality.FEATURES)).astype(np.float32) for n in (1, 2, 5, 3, 1, 4) for _ in range(4)]
    labels = np.array([int(b[:, 0].max() > 0.8) for b in bags])
    m = quality.train(bags, labels, epochs=2)
    sizes = [len(b) for b in bags]
    starts, bag = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(bags)), sizes)
    assert np.allclose(m.forward(np.concatenate(bags), starts, bag)["logit"], [quality_logit_by_hand(m, b) for b in bags], atol=1e-3)

    def loss(model):
        p = [1 / (1 + np.exp(-quality_logit_by_hand(model, b))) for b in bags]
        return -np.mean([np.log(q if y else 1 - q) for q, y in zip(p, labels, strict=True)])

    assert loss(quality.train(bags, labels, epochs=40)) < 0.6 * loss(quality.train(bags, labels, epochs=0))
