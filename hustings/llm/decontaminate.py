"""Benchmark decontamination with a BM25 index of test items and block-max WAND.

Terms are runs of ``TERM`` words. The index holds the test items' terms in lists by item, in blocks with the
largest score of each, scores being BM25 over what the item must reach, so 1 is the threshold for every item.
Every passage of every training text (``PASSAGE`` words, half of them shared with the next one) is a query, and
all items from 1 on are retrieved: passages whose terms' largest scores don't add up to 1 are passed over
all at once, the rest run through WAND, which moves past items, and blocks of them, that can't get there.
A retrieved item is verified on the whole text: the text must have ``OVERLAP`` of the item's distinct runs of ``SHINGLE``
words, and as large a share of those of its question and of its answer (its last sentence). Items of fewer words than a shingle are
looked for as they stand, word for word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.encode import forget
from hustings.llm.store import scratch, ship, whole_texts
from hustings.llm.textops import ALNUM, U, shingle_hashes, steps, text_bytes, word_bounds, word_hashes

TERM, SHINGLE = 3, 5
PASSAGE = 128
#: Share of the score that an item has against itself (or its half-passage part) that a passage must reach.
REACH = 0.5
#: Share of an item's shingles, of its question's and of its answer's, that makes a text contaminated.
OVERLAP = 0.8
K1, B = 1.2, 0.75
#: Items in a block of a list, and bytes of items that one index, broadcast to the executors, holds.
BLOCK, SHARD_BYTES = 32, 16 << 20
SIEVE = 20


@dataclass
class Index:
    items: np.ndarray  # item ids, by place
    terms: np.ndarray  # sorted term hashes
    starts: np.ndarray  # of each term's list
    places: np.ndarray  # postings: item places in order
    scores: np.ndarray  # and their scores
    most: np.ndarray  # largest score of each term
    block_starts: np.ndarray  # of each term's blocks
    block_most: np.ndarray
    shingles: np.ndarray  # sorted shingle hashes of all items
    owner: np.ndarray  # item place of each
    in_answer: np.ndarray
    totals: np.ndarray  # distinct shingles of each item: question, answer
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by number of words below SHINGLE: sorted hashes of whole items, their places, their words

    @property
    def sieve(self) -> np.ndarray:
        if not hasattr(self, "_sieve"):
            self._sieve = np.zeros(1 << SIEVE, bool)
            self._sieve[(self.terms & U((1 << SIEVE) - 1)).astype(np.int64)] = True
        return self._sieve


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_bytes(pa.array(texts, pa.large_string()))
    start, end, doc = word_bounds(data, off, ALNUM)
    return word_hashes(data, start, end), doc


def split_answer(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence or line; all is question where there is only one."""
    cut = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.rstrip())]
    return (text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")


@dataclass
class Whole:
    """What the scores of a shard take from the whole benchmark: its items and their mean length, both without those below SHINGLE
    words, and in how many of them each term is that other shards have too (sorted)."""

    n: int
    average: float
    terms: np.ndarray
    df: np.ndarray


def build(items: list[tuple[int, str]], whole: Whole | None = None) -> Index:
    """The index of (item_id, text) rows; items of fewer words than a shingle are kept whole, outside the lists.

    Scores are those of ``whole``'s benchmark, of which the items are a part; without it the items are all."""
    ids, texts = [i for i, _ in items], [t or "" for _, t in items]
    n = len(items)
    h, doc = _hashed(texts)
    words = np.bincount(doc, minlength=n)
    usable = words >= SHINGLE
    keep = usable[doc] if len(doc) else np.zeros(0, bool)
    s, d = shingle_hashes(h[keep], doc[keep], TERM, n)
    pairs, tf = np.unique(np.stack((s, d.astype(U)), axis=1), axis=0, return_counts=True) if len(s) else (np.zeros((0, 2), U), np.zeros(0))
    terms, inverse, df = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
    place = pairs[:, 1].astype(np.int64)
    length = np.maximum(words - TERM + 1, 1)
    average = float(length[usable].mean()) if usable.any() else 1.0
    count, known = int(usable.sum()), df
    if whole:
        count, average, known = whole.n, whole.average, df.copy()
        _, mine, theirs = np.intersect1d(terms, whole.terms, assume_unique=True, return_indices=True)
        known[mine] = whole.df[theirs]
    idf = np.log(1 + (max(1, count) - known + 0.5) / (known + 0.5))
    score = idf[inverse] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[place] / average))
    own = np.bincount(place, weights=score, minlength=n)
    least = REACH * own * np.minimum(1, PASSAGE / 2 / np.maximum(words, 1))
    score = score / np.maximum(least[place], 1e-12)
    starts = np.concatenate(([0], np.cumsum(df))).astype(np.int64)
    most = np.maximum.reduceat(score, starts[:-1]) if len(terms) else np.zeros(0)
    blocks = -(-df // BLOCK)
    block_starts = np.concatenate(([0], np.cumsum(blocks))).astype(np.int64)
    first = np.concatenate([starts[t] + BLOCK * np.arange(blocks[t]) for t in range(len(terms))]) if len(terms) else np.zeros(0, np.int64)
    block_most = np.maximum.reduceat(score, first) if len(terms) else np.zeros(0)

    s5, d5 = shingle_hashes(h[keep], doc[keep], SHINGLE, n)
    question = [len(_hashed([split_answer(t)[0]])[0]) for t in texts]
    nth = np.arange(len(s5)) - np.searchsorted(d5, d5)
    # a shingle belongs to the answer if its last word does
    tail = nth + SHINGLE > np.array(question, np.int64)[d5] if len(s5) else np.zeros(0, bool)
    order = np.lexsort((tail, d5, s5))
    s5, d5, tail = s5[order], d5[order], tail[order]
    new = np.concatenate(([True], (s5[1:] != s5[:-1]) | (d5[1:] != d5[:-1]))) if len(s5) else np.zeros(0, bool)
    s5, d5, tail = s5[new], d5[new], tail[new]
    short = {}
    first = np.concatenate(([0], np.cumsum(words)))
    for m in range(1, SHINGLE):
        if len(of := np.flatnonzero(words == m)):
            runs = h[first[of][:, None] + np.arange(m)]
            whole = shingle_hashes(runs.ravel(), np.repeat(np.arange(len(of)), m), m, len(of))[0]
            order = np.argsort(whole, kind="stable")
            short[m] = whole[order], of[order], runs[order]
            # the one run of such an item is the answer's if its last word is
            last = m > np.array(question)[of]
            d5, tail, s5 = np.append(d5, of), np.append(tail, last), np.append(s5, whole)
    totals = np.stack((np.bincount(d5, weights=~tail, minlength=n), np.bincount(d5, weights=tail, minlength=n)), axis=1)
    listed = words[d5] >= SHINGLE if len(d5) else np.zeros(0, bool)
    return Index(np.array(ids), terms, starts, place, score, most, block_starts, block_most, s5[listed], d5[listed], tail[listed], totals, short)


def short_items(index: Index, h: np.ndarray, doc: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
    """(document, item place) of the items below SHINGLE words that stand in a document word for word."""
    found = set()
    for m, (hashes, places, runs) in index.short.items():
        s, d = shingle_hashes(h, doc, m, len(first) - 1)
        lo, hi = np.searchsorted(hashes, s), np.searchsorted(hashes, s, side="right")
        at = np.flatnonzero(hi > lo)
        start = first[d[at]] + at - np.searchsorted(d, d[at])
        fits = start + m <= first[d[at] + 1]
        at, start = at[fits], start[fits]
        # one place of each hash in a document is enough
        _, one = np.unique(np.stack((d[at], lo[at]), axis=1), axis=0, return_index=True)
        for k in one:
            same = [j for j in range(lo[at[k]], hi[at[k]]) if (runs[j] == h[start[k] : start[k] + m]).all()]
            found |= {(int(d[at[k]]), int(places[j])) for j in same}
    return found


def wand(index: Index, terms: np.ndarray) -> list[tuple[int, float]]:
    """(item place, score) of all items whose score over the query's terms is 1 or more."""
    lists = [[int(index.starts[t]), int(index.starts[t + 1]), int(t)] for t in terms]
    found = []
    while lists:
        lists.sort(key=lambda x: index.places[x[0]])
        bound, pivot = 0.0, -1
        for i, (_, _, t) in enumerate(lists):
            bound += index.most[t]
            if bound >= 1 - 1e-9:
                pivot = i
                break
        if pivot < 0:
            break
        item = index.places[lists[pivot][0]]
        while pivot + 1 < len(lists) and index.places[lists[pivot + 1][0]] == item:
            pivot += 1
        # the blocks that hold the pivot's item, or would
        bound, upto = 0.0, np.iinfo(np.int64).max
        for at, end, t in lists[: pivot + 1]:
            j = at + int(np.searchsorted(index.places[at:end], item))
            if j < end:
                b = (j - int(index.starts[t])) // BLOCK
                bound += index.block_most[index.block_starts[t] + b]
                last = min(end, int(index.starts[t]) + (b + 1) * BLOCK) - 1
                upto = min(upto, int(index.places[last]))
        if bound < 1 - 1e-9:
            # no item up to the nearest end of a block, or the next list's first item, can reach 1
            upto = min(upto + 1, int(index.places[lists[pivot + 1][0]]) if pivot + 1 < len(lists) else upto + 1)
            target = max(int(item) + 1, upto) if upto > item else int(item) + 1
        else:
            total = 0.0
            for x in lists[: pivot + 1]:
                j = x[0] + int(np.searchsorted(index.places[x[0] : x[1]], item))
                if j < x[1] and index.places[j] == item:
                    total += index.scores[j]
            if total >= 1 - 1e-9:
                found.append((int(item), float(total)))
            target = int(item) + 1
        for x in lists[: pivot + 1]:
            x[0] += int(np.searchsorted(index.places[x[0] : x[1]], target))
        lists = [x for x in lists if x[0] < x[1]]
    return found


def retrieved(index: Index, h: np.ndarray, doc: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], float]:
    """Best score of each (document, item place) that a passage reaches."""
    n, half, mask = len(first) - 1, PASSAGE // 2, U((1 << SIEVE) - 1)
    if len(h) < SHINGLE or not len(index.terms):
        return {}
    s, d = shingle_hashes(h, doc, TERM, n)
    base = np.searchsorted(d, np.arange(n))
    maybe = np.flatnonzero(index.sieve[(s & mask).astype(np.int64)])
    t = np.minimum(np.searchsorted(index.terms, s[maybe]), len(index.terms) - 1)
    real = index.terms[t] == s[maybe]
    at, t = maybe[real], t[real]
    if not len(at):
        return {}
    place = at - base[d[at]]
    # a term is in the passage of its half and in the one before
    per_doc = np.diff(first) // half + 1
    offset = np.concatenate(([0], np.cumsum(per_doc)))
    p = offset[d[at]] + place // half
    again = place >= half
    q, t2 = np.concatenate((p, p[again] - 1)), np.concatenate((t, t[again]))
    key = np.unique(np.stack((q, t2), axis=1), axis=0)
    passages, begin = np.unique(key[:, 0], return_index=True)
    bound = np.add.reduceat(index.most[key[:, 1]], begin)
    best: dict[tuple[int, int], float] = {}
    ends = np.append(begin[1:], len(key))
    for k in np.flatnonzero(bound >= 1 - 1e-9):
        row = int(np.searchsorted(offset, passages[k], side="right")) - 1
        for item, score in wand(index, key[begin[k] : ends[k], 1]):
            best[row, item] = max(best.get((row, item), 0.0), score)
    return best


HITS = "doc_id long, item_id long, bm25 double, overlap double, question_overlap double, answer_overlap double"


def _retrieve(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part, data, off in steps(batches):
            n = part.num_rows
            start, end, doc = word_bounds(data, off, ALNUM)
            h = word_hashes(data, start, end)
            first = np.searchsorted(doc, np.arange(n + 1))
            doc_ids = part["doc_id"].to_pylist()
            rows = []
            for row, item in sorted(short_items(index, h, doc, first)):
                # the whole item: its score against itself, all of its words
                rows.append((doc_ids[row], int(index.items[item]), 1 / REACH, 1.0, *[1.0 if m else None for m in index.totals[item]]))
            best = retrieved(index, h, doc, first)
            for row in sorted({r for r, _ in best}):
                own = np.unique(shingle_hashes(h[first[row] : first[row + 1]], np.zeros(first[row + 1] - first[row], np.int64), SHINGLE, 1)[0])
                lo, hi = np.searchsorted(index.shingles, own), np.searchsorted(index.shingles, own, side="right")
                hit = np.concatenate([np.arange(a, b) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)]) if (hi > lo).any() else np.zeros(0, np.int64)
                for (r, item), score in best.items():
                    if r == row:
                        mine = hit[index.owner[hit] == item]
                        a = int(index.in_answer[mine].sum())
                        got, total = np.array([len(mine) - a, a]), index.totals[item]
                        share = [float(g / m) if m else None for g, m in zip(got, total, strict=True)]
                        rows.append((doc_ids[row], int(index.items[item]), score, float(got.sum() / total.sum()), *share))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *(pa.float64(),) * 4), strict=True)], [x.split()[0] for x in HITS.split(", ")])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, term, n, length) of every item's terms, once each; term null: the items and the sum of their lengths."""
    for part in batches:
        h, doc = _hashed(part["text"].to_pylist())
        words = np.bincount(doc, minlength=part.num_rows)
        usable = words >= SHINGLE
        keep = usable[doc] if len(doc) else np.zeros(0, bool)
        s, d = shingle_hashes(h[keep], doc[keep], TERM, part.num_rows)
        pairs = np.unique(np.stack((s, d.astype(U)), axis=1), axis=0) if len(s) else np.zeros((0, 2), U)
        shard = part["shard"].to_numpy()[pairs[:, 1].astype(np.int64)]
        terms = pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64))
        ones, none = pa.array(np.ones(len(pairs), np.int64)), pa.array(np.zeros(len(pairs), np.int64))
        names = ["shard", "term", "n", "length"]
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), terms, ones, none], names)
        length = int(np.maximum(words - TERM + 1, 1)[usable].sum())
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([int(usable.sum())], pa.int64()), pa.array([length], pa.int64())], names)


def _wholes(items: DataFrame, shards: int) -> Iterator[Whole]:
    """Each shard's ``Whole``; counted on the executors, the driver gets a shard's terms that others have too."""
    spark = items.sparkSession
    ship(spark)
    rows = items.select("shard", "text").mapInArrow(_item_terms, "shard int, term long, n long, length long")
    n, length = rows.filter("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    by_shard = rows.filter("term IS NOT NULL").groupBy("term", "shard").agg(F.sum("n").alias("n"))
    shared = by_shard.groupBy("term").agg(F.sum("n").alias("df"), F.collect_list("shard").alias("shard")).filter(F.size("shard") > 1)
    path = scratch(spark, "terms")
    shared.select("term", "df", F.explode("shard").alias("shard")).write.parquet(path)
    for k in range(shards):
        got = spark.read.parquet(path).filter(F.col("shard") == k).select("term", "df").toArrow()
        terms = got["term"].to_numpy().astype(np.int64).view(U)
        order = np.argsort(terms)
        yield Whole(n, length / n if n else 1.0, terms[order], got["df"].to_numpy()[order])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, bm25, overlap, question_overlap, answer_overlap) of every retrieved pair, verified or not.

    The benchmark (item_id, text) is taken in shards of about ``SHARD_BYTES``, so each index that the executors
    are given is bounded; each shard reads the documents once. Scores are those of the whole benchmark. Null texts are empty, null item_ids are left out,
    rows that share an item_id are items of their own, and rows of docs that share a doc_id (null too) have rows each for itself.
    A text is searched and verified whole, whatever its length, and no part of it is held twice.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / SHARD_BYTES))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    texts, hits = whole_texts(docs), None
    for k, whole in enumerate(_wholes(items, shards) if shards > 1 else [None]):
        rows = items.filter(F.col("shard") == k).select("item_id", "text").orderBy("item_id", "text").collect()
        part = texts.mapInArrow(_retrieve(build([tuple(r) for r in rows], whole)), HITS)
        hits = part if hits is None else hits.unionByName(part)
    return hits


def verified(overlap: float = OVERLAP) -> Column:
    """Of a row of ``contaminated``: whether the text has that share of the item, of its question and of its answer, where it has one."""
    part = lambda c: F.coalesce(F.col(c) >= overlap, F.lit(True))
    return (F.col("overlap") >= overlap) & part("question_overlap") & part("answer_overlap")


def decontaminate(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """One row for each row of docs: doc_id, contaminated, n_items (verified ones), item_id (a verified one before others, that of
    the largest overlap, then the least), overlap, question_overlap, answer_overlap (of that item; null without a retrieved one).

    docs: doc_id, text and other columns, which are ignored. Null and empty texts are clean. Rows that share a
    doc_id share what was found in either; null doc_ids share too. An empty table or benchmark gives clean rows or none.
    Texts of any length are searched whole.
    """
    by_doc = contaminated(docs, benchmark).groupBy(F.col("doc_id").alias("id")).agg(
        F.count_distinct(F.when(verified(overlap), F.col("item_id"))).alias("n_items"),
        F.min(F.struct((~verified(overlap)).alias("open"), (-F.col("overlap")).alias("less"), "item_id", "overlap", "question_overlap", "answer_overlap")).alias("best"),
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(by_doc, ids.doc_id.eqNullSafe(by_doc.id), "left").select(
        "doc_id", (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        *[F.col(f"best.{c}").alias(c) for c in ("item_id", "overlap", "question_overlap", "answer_overlap")],
    )
