"""Simple-8b with escapes: 4 bits of a 64-bit word select how many ids its other 60 bits hold.

A field of all ones, in words with fields under 60 bits, is an escape: its id is the next of the
block's list of 32-bit escapes. So a long run of small ids needs no short words for a few large ones.
Words and escapes are decoded by whole arrays; nothing depends on the word before.
"""

from __future__ import annotations

import struct

import numpy as np

U = np.uint64
#: Fixed values: (ids, bits of each) by selector, most ids first.
FIELDS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
HEAD = struct.Struct("<4sIIII")
MAGIC = b"S8B1"


def _lengths(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the selector that a word starting there would have, and its ids."""
    n, v = len(v), v.astype(np.uint32)
    best = np.full(n, len(FIELDS) - 1, np.uint8)
    open_ = np.ones(n, bool)
    # words of 8 ids and more have at most an escape for each 8, so they hold 8 ids in a row with one escape
    few = np.zeros(n + 1, np.int32)
    np.cumsum(v >= np.uint32(127), out=few[1:], dtype=np.int32)
    dense = n >= 8 and bool((few[8:] - few[:-8] <= 1).any())
    for s, (count, bits) in enumerate(FIELDS[:-1]):
        if count > n or (count >= 8 and not dense):
            continue
        # escapes cost 4 bytes each, so a word may have one for each 8 ids, or one of 5 to 7
        allowed = count // 8 if count >= 8 else int(count >= 5)
        large = np.zeros(n + 1, np.int32)
        np.cumsum(v >= np.uint32((1 << bits) - 1), out=large[1:], dtype=np.int32)
        fits = (large[count:] - large[: n + 1 - count]) <= allowed
        take = open_[: n + 1 - count] & fits
        best[: n + 1 - count][take] = s
        open_[: n + 1 - count][take] = False
    return best, np.array([c for c, _ in FIELDS])[best]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned ids below 2**32."""
    v = ids.astype(U)
    n = len(v)
    if not n:
        return np.zeros(0, U), np.zeros(0, "<u4")
    best, step = _lengths(v)
    # where words start: with the way of 2**k words from every place, as many starts as are known give the next ones
    way = np.append(np.minimum(np.arange(n) + step, n), n)
    at = np.zeros(1, np.int64)
    while True:
        more = way.take(at)
        more = more[more < n]
        at = np.concatenate((at, more))
        if 2 * len(more) < len(at):
            break
        way = way.take(way)
    words = best[at].astype(U)
    escaped = np.zeros(n, bool)
    for s in np.unique(best[at]):
        count, bits = FIELDS[s]
        mine = at[best[at] == s]
        fields = v[mine[:, None] + np.arange(count)]
        if bits < 60:
            over = fields >= U((1 << bits) - 1)
            escaped[(mine[:, None] + np.arange(count))[over]] = True
            fields = np.where(over, U((1 << bits) - 1), fields)
        shifts = (U(4) + np.arange(count, dtype=U) * U(bits))[None, :]
        words[best[at] == s] |= np.bitwise_or.reduce(fields << shifts, axis=1)
    return words, v[escaped].astype("<u4")


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    selectors = (words & U(15)).astype(np.int64)
    counts = np.array([c for c, _ in FIELDS] + [0, 0])[selectors]
    ends = np.cumsum(counts)
    out, marks = np.zeros(n, U), np.zeros(n, bool)
    for s in np.unique(selectors):
        count, bits = FIELDS[s]
        mine = selectors == s
        mask = U((1 << bits) - 1)
        fields = (words[mine][:, None] >> (U(4) + np.arange(count, dtype=U) * U(bits))[None, :]) & mask
        place = (ends[mine] - count)[:, None] + np.arange(count)
        out[place] = fields
        if bits < 60:
            marks[place] = fields == mask
    out[marks] = escapes
    return out.astype("<u4")


def block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: head (magic, documents, ids, words, escapes), doc_ids, ends of documents, words, escapes."""
    words, escapes = pack(ids)
    ends = np.cumsum(lengths, dtype=np.int64).astype("<u4")
    return HEAD.pack(MAGIC, len(doc_ids), len(ids), len(words), len(escapes)) + doc_ids.astype("<i8").tobytes() + ends.tobytes() + words.astype("<u8").tobytes() + escapes.tobytes()


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ends, ids) of a block."""
    magic, docs, n, words, escapes = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b block")
    at = HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    ends = np.frombuffer(data, "<u4", docs, at := at + 8 * docs)
    coded = np.frombuffer(data, "<u8", words, at := at + 4 * docs)
    rest = np.frombuffer(data, "<u4", escapes, at + 8 * words)
    return doc_ids, ends, unpack(coded.astype(U), rest, n)
