"""Vectorised views of Arrow text columns: bytes, word bounds and 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that one numpy step holds at once; a longer document is a step of its own.
STEP = 3 << 19
_BASE = U(0x9E3779B97F4A7C15)
_pow: list[np.ndarray] = []


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n+1) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of whole documents of about ``most`` bytes."""
    for batch in batches:
        data, off = text_bytes(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def table_of(members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


#: Words of `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~table_of(b" \t\n\x0b\x0c\r")
#: Words of digits, letters (either case) and all bytes above ASCII.
ALNUM = table_of(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


#: A random word for each byte; A-Z have those of a-z.
BYTE_WORD = mix(np.arange(1, 257, dtype=U) * _BASE)
BYTE_WORD[0x41:0x5B] = BYTE_WORD[0x61:0x7B]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if not _pow or len(_pow[0]) < n:
        size = max(n, STEP + 1)
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        out = []
        for b in (_BASE, inverse):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 4 * STEP:
            return out[0], out[1]
        _pow[:] = out
    return _pow[0], _pow[1]


def word_bounds(data: np.ndarray, off: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word; words don't cross documents."""
    n = len(data)
    w = np.zeros(n + 2, bool)
    w[1:-1] = members[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = np.flatnonzero(w[1:] & (~w[:-1] | edge))
    end = np.flatnonzero(w[:-1] & (~w[1:] | edge))
    doc = np.searchsorted(off, start, side="right") - 1
    return start, end, doc


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums over the bytes, from which ``word_hashes`` has the hash of any run of them."""
    p, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_WORD[data] * p[: len(data)], out=sums[1:])
    return sums


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of words, the same for A-Z and a-z; ``sums`` are the ``byte_sums`` of data, if the caller has them."""
    if not len(start):
        return np.zeros(0, U)
    _, inv = powers(len(data) + 1)
    sums = byte_sums(data) if sums is None else sums
    return mix((sums[end] - sums[start]) * inv[start])


def shingle_hashes(h: np.ndarray, doc: np.ndarray, k: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words of a document (of all its words, if fewer) and their documents; repeats stay."""
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    out, docs = [], []
    if len(h) >= k:
        full = doc[: len(h) - k + 1] == doc[k - 1 :]
        s = np.zeros(len(h) - k + 1, U)
        for i in range(k):
            s = mix(s + h[i : len(h) - k + 1 + i] + np.uint64((i + 1) * int(_BASE) & (2**64 - 1)))
        out.append(s[full])
        docs.append(doc[: len(h) - k + 1][full])
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        s = mix(np.full(1, counts[d], U) * _BASE)
        for x in h[first[d] : first[d] + counts[d]]:
            s = mix(s * U(3) + x)
        out.append(s)
        docs.append(np.array([d]))
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    s, d = np.concatenate(out), np.concatenate(docs)
    order = np.argsort(d, kind="stable")
    return s[order], d[order]
