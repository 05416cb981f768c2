"""License scans: fuzzy search for short notices, exact seeds first.

A notice that may hold up to k edits is split into k + 1 parts of about the same length; by the pigeonhole principle
one part stands unedited, so exact searches for the parts miss no occurrence. Where a seed stands, the
``regex`` library matches the notice with at most k edits in the words around it, and its span and number
of edits are reported. The contract's phrases are notices with no edits: their seed is the phrase itself.

Texts are searched as words: A-Z lower-cased, every run of other characters one space, so a notice that
is wrapped, indented or commented still matches. A document is searched as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hustings.llm.store import whole_texts
from hustings.llm.textops import ALNUM, steps, word_bounds


@dataclass(frozen=True)
class Notice:
    """A phrase in lower-case words, its label, and the edits (insertions, deletions, substitutions of characters) it may hold."""

    label: str
    phrase: str
    edits: int = 0


#: The phrases and labels of the contract.
BASE = (Notice("mit", "mit license"), Notice("apache", "apache license"), Notice("gpl", "general public license"))
#: Openings of well-known notices, with the edits that still make one of them.
FUZZY = (
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("mit", "released under the mit license", 2),
    Notice("apache", "licensed under the apache license version 2 0", 3),
    Notice("gpl", "under the terms of the gnu general public license", 4),
    Notice("gpl", "either version 3 of the license or at your option any later version", 5),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("mpl", "subject to the terms of the mozilla public license", 4),
    Notice("cc", "licensed under a creative commons attribution", 3),
    Notice("spdx", "spdx license identifier", 1),
    Notice("reserved", "all rights reserved", 1),
)
_fold = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def seeds(notice: Notice) -> list[tuple[bytes, int]]:
    """(part, its place in the phrase): edits + 1 parts of about the same length, none of them empty."""
    phrase = notice.phrase.encode()
    n = notice.edits + 1
    cuts = [round(i * len(phrase) / n) for i in range(n + 1)]
    return [(phrase[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache
def _compiled(notice: Notice) -> regex.Pattern:
    # bounded by words on both sides; the fewest edits win
    body = regex.escape(notice.phrase)
    within = f"(?:{body}){{e<={notice.edits}}}" if notice.edits else f"(?:{body})"
    return regex.compile(f"(?b)(?<![^ ]){within}(?![^ ])".encode())


def find(text: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of a notice in a text of words with single spaces; overlapping ones once each."""
    if not notice.edits:
        found, at = [], text.find(phrase := notice.phrase.encode())
        while at >= 0:
            if m := _compiled(notice).match(text, at):
                found.append((m.start(), m.end(), 0))
            at = text.find(phrase, at + 1)
        return found
    spots = []
    for part, place in seeds(notice):
        at = text.find(part)
        while at >= 0:
            spots.append(at - place)
            at = text.find(part, at + 1)
    found, upto = [], 0
    for spot in sorted(set(spots)):
        # words between that an occurrence around this seed can't leave; where the last one ended, the next may begin
        lo, hi = max(upto, spot - notice.edits), min(len(text), spot + len(notice.phrase) + notice.edits)
        if lo and text[lo - 1] != 32:
            lo = text.find(b" ", lo) + 1 or len(text)
        if hi < len(text) and text[hi] != 32:
            hi = text.rfind(b" ", 0, hi)
        if within := _within(text, notice, lo, hi):
            found += within
            upto = within[-1][1]
    return found


def _within(text: bytes, notice: Notice, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """The best match between two word bounds, with those before and after it."""
    if hi - lo < len(notice.phrase) - notice.edits or not (m := _compiled(notice).search(text, lo, hi)):
        return []
    return [*_within(text, notice, lo, m.start()), (m.start(), m.end(), sum(m.fuzzy_counts)), *_within(text, notice, m.end(), hi)]


ROW = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def _scan(base: tuple[Notice, ...], fuzzy: tuple[Notice, ...]):
    quick = [(n, [s for s, _ in seeds(n)]) for n in fuzzy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in steps(batches):
            lower = np.frombuffer(data.tobytes().translate(_fold), np.uint8)
            start, end, doc = word_bounds(lower, off, ALNUM)
            n_words = np.bincount(doc, minlength=part.num_rows)
            # words of all documents with one space between, a line end between documents
            lengths = end - start
            at = np.concatenate(([0], np.cumsum(lengths + 1)))
            clean = np.full(int(at[-1]) if len(at) else 0, 32, np.uint8)
            keep = np.zeros(len(lower) + 1, np.int8)
            np.add.at(keep, start, 1)
            np.add.at(keep, end, -1)
            inside = np.ones(len(clean), bool)
            inside[at[1:] - 1] = False
            clean[inside] = lower[np.cumsum(keep[:-1]).astype(bool)]
            last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
            clean[at[1:][last] - 1] = 10
            words = clean.tobytes()
            first_of = np.concatenate(([0], np.cumsum(n_words)))
            # which documents hold a seed: searched over the whole step at once
            hits: dict[int, list[tuple[int, int, int, int]]] = {}
            for which, notice in enumerate((*base, *fuzzy)):
                parts = [notice.phrase.encode()] if which < len(base) else quick[which - len(base)][1]
                docs = set()
                for seed in parts:
                    i = words.find(seed)
                    while i >= 0:
                        d = int(doc[np.searchsorted(at, i, side="right") - 1])
                        docs.add(d)
                        i = words.find(seed, i + 1 if which < len(base) else int(at[first_of[d + 1]]))
                for d in docs:
                    a, b = int(at[first_of[d]]), int(at[first_of[d + 1]]) - 1
                    for s, e, edits in find(words[a:b], notice):
                        w = int(np.searchsorted(at, a + s, side="right")) - 1 - int(first_of[d])
                        v = int(np.searchsorted(at, a + e - 1, side="right")) - int(first_of[d])
                        hits.setdefault(d, []).append((w, v, which, edits))
            rows = []
            for d, doc_id in enumerate(part["doc_id"].to_pylist()):
                found = sorted(hits.get(d, ()))
                own = [x for x in found if x[2] < len(base)]
                label = lambda xs: ",".join(sorted({(*base, *fuzzy)[x[2]].label for x in xs}))
                close = [1 - x[3] / len((*base, *fuzzy)[x[2]].phrase) for x in found]
                starts = [x[0] for x in own]
                spans = ",".join(f"{(*base, *fuzzy)[x[2]].label}:{x[0]}:{x[1]}:{x[3]}" for x in found)
                rows.append((doc_id, int(n_words[d]), len(own), min(starts, default=None), max(starts, default=None), label(own), label(found), max(close, default=0.0), spans))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

    return run


NAMES = [x.split()[0] for x in ROW.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in ROW.split(", ")]


def license_scan(docs: DataFrame, base: tuple[Notice, ...] = BASE, fuzzy: tuple[Notice, ...] = FUZZY) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    docs: doc_id, text (null: empty, no words and score 0) and other columns, which are ignored. ``spans`` lists
    label:first word:word after the last:edits of every notice found. The score is the closeness of the best one:
    1 without edits, less by each edit's share of the phrase, 0 without a notice. Repeated rows and null doc_ids
    are returned as they come; an empty table gives no rows. Notices that overlap are each listed, copies of one notice
    that overlap once, the closest first. Texts never leave the task that reads them, and one of any length is a step of its own.
    """
    return whole_texts(docs).mapInArrow(_scan(base, fuzzy), ROW)
