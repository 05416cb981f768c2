"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Every string of ``WIDTH`` bytes (a window) has an anchor, the least-hashed gram of ``GRAM`` bytes in it, so equal
windows share an anchor at the same place. Suffix arrays are built over anchors alone: their suffixes sorted, with
the common prefix of neighbours, and the texts before them sorted backwards. A window x bytes before its anchor
equals another if the two anchors agree in x bytes backwards and WIDTH - x forwards; both are classes of runs of
the two arrays, whatever x is.

``IndexFamily`` takes batches: a batch gets its arrays and is resolved in itself, is scanned against each level
for windows that the level has too, and becomes a level; levels of about the same size merge. It is used twice:

1. Documents are dealt to senders by a hash of doc_id, once; later steps read the same exchange. A sender tells
   the owners of hash ranges which anchors it has (sorted, Rice-coded); owners answer with bitmaps of those that
   more senders have. All others can only repeat within the sender.
2. A sender resolves its own repeated anchors in a family of its own, so each window leaves it once at most, and
   sends the windows of shared anchors to buckets of the anchor's hash; those of an anchor that over ``HOT`` senders
   have go window by window to buckets of the window's hash, so that a very common passage, and whatever stands
   beside it, is spread over all buckets.
3. A bucket feeds what it gets, in batches of many senders, to its family, and returns the windows that come earlier elsewhere.
4. Senders cut the spans out of their documents.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.exact_dedup import rice_decode, rice_encode
from hustings.llm.store import partitions, whole_texts
from hustings.llm.textops import STEP, mix, text_bytes

U = np.uint64
WIDTH, GRAM = 100, 20
#: Grams in a window, so windows that an anchor can have.
SPREAD = WIDTH - GRAM + 1
#: Senders beyond which an anchor's windows are dealt one by one.
HOT = 4096
#: Senders for each shuffle partition; a sender's documents and their arrays are held at once.
SENDERS = 3
#: Anchors of a batch that a family takes.
BATCH = 30_000
#: A repeated row of a doc_id is another document; its number is above the positions in a text.
AGAIN = 36
PAD = 128
_K = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]


def padded(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 2 * PAD, np.uint8)
    out[PAD : PAD + len(data)] = data
    return out


def words_at(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Little-endian words of 8 bytes at any positions of a buffer."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))[at]


def gram_hashes(buffer: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    view = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    if isinstance(at, slice):
        a, b = at.start, at.stop
        return mix(view[a:b] * _K[0] + view[a + 8 : b + 8] * _K[1] + view[a + 12 : b + 12] * _K[2])
    return mix(view[at] * _K[0] + view[at + 8] * _K[1] + view[at + 12] * _K[2])


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of windows with one anchor; positions in data."""
    n = len(data)
    if n < WIDTH:
        return (np.zeros(0, np.int64),) * 3
    buffer = padded(data)
    keys = gram_hashes(buffer, slice(PAD, PAD + n))
    # 40 bits of the hash, then the position, so the leftmost of equal grams
    keys &= ~U((1 << 24) - 1)
    step = 1 << 23
    out = []
    for a in range(0, n - WIDTH + 1, step):
        b = min(n - WIDTH + 1, a + step)
        m = keys[a : b + SPREAD - 1] | np.arange(b + SPREAD - 1 - a, dtype=U)
        reach = 1
        while 2 * reach <= SPREAD:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        if reach < SPREAD:
            rest = SPREAD - reach
            m = np.minimum(m[: len(m) - rest], m[rest:])
        out.append((m & U((1 << 24) - 1)).astype(np.int64) + a)
    at = np.concatenate(out)
    start = np.arange(len(at))
    length = np.diff(off)
    whole = np.repeat(off[1:], length)[: len(at)] - start >= WIDTH
    first = np.flatnonzero(whole & np.concatenate(([True], (at[1:] != at[:-1]) | ~whole[:-1] | (np.isin(start[1:], off)))))
    ends = np.flatnonzero(whole & np.concatenate(((at[1:] != at[:-1]) | ~whole[1:] | np.isin(start[1:], off), [True])))
    return at[first], first, ends


@dataclass
class Entries:
    """Anchors with their windows: hash, words forwards and backwards, document, its number and the anchor's
    position, and which windows x bytes before the anchor are still the first of their kind."""

    h: np.ndarray
    right: np.ndarray
    left: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    live: np.ndarray
    key: np.ndarray  # the caller's: row of what it sent

    def __len__(self) -> int:
        return len(self.h)

    def take(self, i: np.ndarray) -> Entries:
        return Entries(*(getattr(self, f.name)[i] for f in fields(self)))

    @staticmethod
    def join(a: Entries, b: Entries) -> Entries:
        return Entries(*(np.concatenate((getattr(a, f.name), getattr(b, f.name))) for f in fields(Entries)))


def entries(buffer: np.ndarray, anchor: np.ndarray, x_low: np.ndarray, x_high: np.ndarray, doc: np.ndarray, at: np.ndarray, key: np.ndarray) -> Entries:
    """anchor: position in the padded buffer; at: position in the document, with its number above."""
    right = np.stack([words_at(buffer, anchor + 8 * i).byteswap() for i in range((WIDTH + 7) // 8)], axis=1)
    left = np.stack([words_at(buffer, anchor - 8 * (i + 1)) for i in range((SPREAD + 6) // 8)], axis=1)
    x = np.arange(SPREAD)[None, :]
    return Entries(gram_hashes(buffer, anchor), right, left, doc, at, (x >= x_low[:, None]) & (x <= x_high[:, None]), key)


def _array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row, common bytes of each sorted row with the one before)."""
    order = np.lexsort(words.T[::-1])
    s = words[order]
    differ = s[1:] ^ s[:-1]
    which = np.argmax(differ != 0, axis=1)
    word = differ[np.arange(len(differ)), which]
    # leading zero bytes of the first word that differs
    lead = np.full(len(word), 8, np.int64)
    for byte in range(8):
        lead[(lead == 8) & ((word >> U(8 * (7 - byte))) & U(255) != 0)] = byte
    same = np.where(word == 0, 8 * words.shape[1], 8 * which + lead)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.concatenate(([0], same))


def resolve(e: Entries) -> None:
    """Of equal live windows only the first by document and position stays live."""
    n = len(e)
    if n < 2:
        return
    by_place = np.lexsort((e.at, e.doc))
    rank_r, same_r = _array(e.right[by_place])
    rank_l, same_l = _array(e.left[by_place])
    live = e.live[by_place]
    index = np.arange(n)
    for x in range(SPREAD):
        rows = np.flatnonzero(live[:, x])
        if len(rows) < 2:
            continue
        run_r = np.maximum.accumulate(np.where(same_r < WIDTH - x, index, 0))
        run_l = np.maximum.accumulate(np.where(same_l < x, index, 0))
        key = run_r[rank_r[rows]] * n + run_l[rank_l[rows]]
        m = len(rows)
        if n * n * m < 1 << 63:
            # places are sorted along with the keys: one sort of plain numbers
            both = key * m + np.arange(m)
            both.sort()
            k = both // m
            again = k[1:] == k[:-1]
            later = both[1:][again] - k[1:][again] * m
        else:
            order = np.argsort(key, kind="stable")
            k = key[order]
            later = order[1:][k[1:] == k[:-1]]
        live[rows[later], x] = False
    e.live[by_place] = live


class IndexFamily:
    """Levels of entries whose live windows are the only ones of their kind in the family."""

    def __init__(self) -> None:
        self.levels: list[Entries] = []
        self.scans = 0

    def add(self, batch: Entries) -> None:
        """Levels and batch keep, of equal windows, the first; ask ``windows`` at the end which ones stayed."""
        again = np.unique(batch.h, return_counts=True)
        more = np.flatnonzero(np.isin(batch.h, again[0][again[1] > 1]))
        part = batch.take(more)
        resolve(part)
        batch.live[more] = part.live
        for level in self.levels:
            self._scan(level, batch)
        batch = batch.take(np.argsort(batch.h, kind="stable"))
        while self.levels and len(self.levels[-1]) <= 2 * len(batch):
            both = Entries.join(self.levels.pop(), batch)
            batch = both.take(np.argsort(both.h, kind="stable"))
        self.levels.append(batch)

    def _scan(self, level: Entries, batch: Entries) -> None:
        """Merge the parts of both that share anchors and resolve them against each other."""
        mine = np.flatnonzero(np.isin(batch.h, level.h) & batch.live.any(axis=1))
        if not len(mine):
            return
        wanted = np.unique(batch.h[mine])
        lo, hi = np.searchsorted(level.h, wanted), np.searchsorted(level.h, wanted, side="right")
        theirs = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(int((hi - lo).sum()))
        theirs = theirs[level.live[theirs].any(axis=1)]
        both = Entries.join(level.take(theirs), batch.take(mine))
        resolve(both)
        level.live[theirs] = both.live[: len(theirs)]
        batch.live[mine] = both.live[len(theirs) :]
        self.scans += 1

    def all(self) -> Entries | None:
        out = None
        for level in self.levels:
            out = level if out is None else Entries.join(out, level)
        return out


# --- senders -----------------------------------------------------------------


@dataclass
class Held:
    """A sender's documents in order of doc_id and text: bytes, bounds, ids, and number among rows of one doc_id."""

    data: np.ndarray
    off: np.ndarray
    doc: np.ndarray
    again: np.ndarray
    null: np.ndarray


def held(table: pa.Table) -> Held:
    table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    data, off = text_bytes(table["text"])
    null = table["doc_id"].is_null().to_numpy()
    doc = table["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
    order = np.argsort(doc, kind="stable")  # nulls come last in Arrow's order, first in ours
    again = np.zeros(len(doc), np.int64)
    s = doc[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    again[order] = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return Held(data, off, doc, again, null)


def _runs(off: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents of about half a step each: a position has several words of 8 bytes here."""
    out, i = [], 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + STEP // 2, side="right")) - 1)
        out.append((i, j))
        i = j
    return out


def all_anchors(d: Held) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for i, j in _runs(d.off):
        a, b = d.off[i], d.off[j]
        at, first, last = anchors(d.data[a:b], d.off[i : j + 1] - a)
        h = gram_hashes(padded(d.data[a:b]), at + PAD) if len(at) else np.zeros(0, U)
        parts.append((at + a, first + a, last + a, h))
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


#: Bits of an anchor's hash that senders exchange.
EXCHANGED = 48


def _edges(owners: int) -> np.ndarray:
    return np.array([(i << EXCHANGED) // owners for i in range(owners + 1)], U)


def tell_anchors(owners: int):
    def run(table: pa.Table) -> pa.Table:
        sender, d = table["sender"][0].as_py(), held(table)
        seen = np.unique(all_anchors(d)[3] >> U(64 - EXCHANGED))
        edges = _edges(owners)
        cut = np.searchsorted(seen, edges)
        rows = []
        for o in range(owners):
            if cut[o] < cut[o + 1]:
                part = seen[cut[o] : cut[o + 1]] - edges[o]
                rows.append((o, sender, len(part), *rice_encode(part)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["owner", "sender", "n", "k", "blob"])

    return run


def answer(table: pa.Table) -> pa.Table:
    """For each sender two bitmaps over its anchors of this range: shared with a sender, shared with over HOT."""
    owner, senders = table["owner"][0].as_py(), table["sender"].to_pylist()
    parts = [rice_decode(n, k, b) for n, k, b in zip(table["n"].to_pylist(), table["k"].to_pylist(), table["blob"].to_pylist(), strict=True)]
    # all senders at once: there are more of them the larger the input is
    _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    have, cuts = counts[inverse], np.cumsum([len(p) for p in parts])[:-1]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    shared, hot = ([squeeze(np.packbits(x).tobytes()) for x in np.split(have > least, cuts)] for least in (1, HOT))
    return pa.table(
        [pa.array([owner] * len(senders), pa.int32()), pa.array(senders, pa.int32()), pa.array([len(p) for p in parts], pa.int64()), pa.array(shared, pa.binary()), pa.array(hot, pa.binary())],
        names=["owner", "sender", "n", "shared", "hot"],
    )


def _runs_of(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of each run of set places in the rows."""
    edge = np.diff(np.pad(windows, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _mark_blob(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
    """Runs of marked windows, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(doc.astype("<i8").tobytes() + first.astype("<i8").tobytes() + last.astype("<i8").tobytes())


def send_windows(buckets: int):
    """A sender's shared windows for the buckets, and the windows that repeat within the sender itself."""

    def run(docs: pa.Table, maps: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.bool_()), pa.array([], pa.binary())], names=["bucket", "sender", "done", "blob"])
        if not docs.num_rows:
            return empty
        sender, d = docs["sender"][0].as_py(), held(docs)
        at, first, last, h = all_anchors(d)
        if not len(at):
            return empty
        short = h >> U(64 - EXCHANGED)
        seen, inverse, counts = np.unique(short, return_inverse=True, return_counts=True)
        order, n = np.argsort(maps["owner"].to_numpy()), maps["n"].to_pylist()
        expand = zstandard.ZstdDecompressor().decompress
        flags = []
        for name in ("shared", "hot"):
            blobs = maps[name].to_pylist()
            bits = [np.unpackbits(np.frombuffer(expand(blobs[i]), np.uint8))[: n[i]] for i in order]
            flags.append(np.concatenate(bits).astype(bool)[inverse])
        shared, hot = flags
        use = np.flatnonzero(shared | (counts > 1)[inverse])
        buffer = padded(d.data)
        which = np.searchsorted(d.off, at[use], side="right") - 1
        family, rows, mark_doc, mark_at = IndexFamily(), [], [], []
        # batches of anchors in order of the documents
        for i in range(0, len(use), BATCH):
            u, w = use[i : i + BATCH], which[i : i + BATCH]
            place = (d.again[w] << AGAIN) + at[u] - d.off[w]
            family.add(entries(buffer, at[u] + PAD, at[u] - last[u], at[u] - first[u], d.doc[w], place, u))
        e = family.all()
        if e is None:
            return empty
        x = np.arange(SPREAD)[None, :]
        born = (x >= (at[e.key] - last[e.key])[:, None]) & (x <= (at[e.key] - first[e.key])[:, None])
        row, low, high = _runs_of(born & ~e.live)
        if len(row):
            rows.append((sender % buckets, sender, True, _mark_blob(e.doc[row], e.at[row] - high, e.at[row] - low)))
        out = np.flatnonzero(shared[e.key] & e.live.any(axis=1))
        # runs of live windows of an entry, or single windows where the anchor is hot
        live = e.live[out]
        row, x_low, x_high = _runs_of(live)
        single = hot[e.key[out[row]]]
        more = np.where(single, x_high - x_low + 1, 1)
        row, base = np.repeat(row, more), np.repeat(x_low, more)
        shift = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(more)[:-1])), more)
        single = np.repeat(single, more)
        x_low = base + np.where(single, shift, 0)
        x_high = np.where(single, x_low, np.repeat(x_high, more))
        anchor, key = at[e.key[out[row]]], out[row]
        to = mix(e.h[key] ^ _K[0])
        if single.any():
            begin = anchor[single] - x_low[single] + PAD
            own = np.zeros(len(begin), U)
            for j in range(0, 96, 8):
                own = mix(own + words_at(buffer, begin + j))
            to[single] = mix(own + words_at(buffer, begin + WIDTH - 8))
        to = (to % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in range(buckets):
            mine = order[cuts[b] : cuts[b + 1]]
            if len(mine):
                begin, length = anchor[mine] - x_high[mine], WIDTH + x_high[mine] - x_low[mine]
                ends = np.cumsum(length)
                text = d.data[np.repeat(begin - ends + length, length) + np.arange(int(ends[-1]))]
                head = np.array([len(mine)], "<i8").tobytes()
                columns = e.doc[key[mine]].astype("<i8").tobytes() + e.at[key[mine]].astype("<i8").tobytes() + x_low[mine].astype("u1").tobytes() + x_high[mine].astype("u1").tobytes()
                rows.append((b, sender, False, squeeze(head + columns + text.tobytes())))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "sender", "done", "blob"])

    return run


def compare(table: pa.Table) -> pa.Table:
    """A bucket's family over all senders' windows; marks go back to each sender."""
    done, senders, blobs = table["done"].to_pylist(), table["sender"].to_pylist(), table["blob"].to_pylist()
    expand = zstandard.ZstdDecompressor().decompress
    family, rows, base = IndexFamily(), [], 0
    held_back, size = [], 0

    def feed() -> None:
        """What several senders sent is one batch: each batch is scanned against all levels, whatever its size."""
        nonlocal base, size
        if not held_back:
            return
        doc, at, low, high, who = (np.concatenate(c) for c in zip(*(h[:5] for h in held_back), strict=True))
        buffer, length = padded(np.concatenate([h[5] for h in held_back])), WIDTH + high - low
        anchor = np.cumsum(length) - length + high + PAD
        family.add(entries(buffer, anchor, low, high, doc, at, np.arange(base, base + len(doc))))
        rows.append((low, high, who))
        base, size = base + len(doc), 0
        held_back.clear()

    for sender, finished, blob in zip(senders, done, blobs, strict=True):
        if finished:
            continue
        raw = expand(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        doc, at = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        low, high = (np.frombuffer(raw, "u1", n, 8 + (16 + k) * n).astype(np.int64) for k in (0, 1))
        held_back.append((doc, at, low, high, np.full(n, sender), np.frombuffer(raw, np.uint8, -1, 8 + 18 * n)))
        size += n
        if size >= BATCH:
            feed()
    feed()
    out_sender, out_blob = [s for s, d in zip(senders, done, strict=True) if d], [b for b, d in zip(blobs, done, strict=True) if d]
    if rows:
        lows, highs, who = (np.concatenate(c) for c in zip(*rows, strict=True))
    for e in family.levels:
        x, low, high = np.arange(SPREAD)[None, :], lows[e.key], highs[e.key]
        row, near, far = _runs_of((x >= low[:, None]) & (x <= high[:, None]) & ~e.live)
        to = who[e.key[row]]
        order = np.argsort(to, kind="stable")
        row, near, far, to = row[order], near[order], far[order], to[order]
        doc, first, last = e.doc[row], e.at[row] - far, e.at[row] - near
        edges = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)])) if len(to) else [0]
        for i, j in zip(edges, edges[1:], strict=False):
            out_sender.append(int(to[i]))
            out_blob.append(_mark_blob(doc[i:j], first[i:j], last[i:j]))
    return pa.table([pa.array(out_sender, pa.int32()), pa.array(out_blob, pa.binary())], names=["sender", "blob"])


def cut(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """What stays of each document."""
    d = held(docs) if docs.num_rows else Held(np.zeros(0, np.uint8), np.zeros(1, np.int64), *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool))
    expand = zstandard.ZstdDecompressor().decompress
    parts = [np.frombuffer(expand(b), "<i8").reshape(3, -1) for b in marks["blob"].to_pylist()]
    change = np.zeros(len(d.data) + 1, np.int32)
    if parts and docs.num_rows:
        doc, first, last = np.concatenate(parts, axis=1)
        order = np.lexsort((d.again, d.doc))
        begin = np.empty(len(order), [("doc", np.int64), ("again", np.int64)])
        begin["doc"], begin["again"] = d.doc[order], d.again[order]
        want = np.empty(len(doc), begin.dtype)
        want["doc"], want["again"] = doc, first >> AGAIN
        row = order[np.searchsorted(begin, want)]
        low = d.off[row] - (want["again"] << AGAIN)
        np.add.at(change, first + low, 1)
        np.add.at(change, last + low + WIDTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    # a run ends with its document
    begins = gone & ~np.concatenate(([False], gone[:-1]))[: len(gone)]
    inner = d.off[:-1][np.diff(d.off) > 0]
    begins[inner] = gone[inner]
    upto = np.concatenate(([0], np.cumsum(gone)))
    runs = np.concatenate(([0], np.cumsum(begins)))
    kept = d.data[~gone]
    at = d.off - upto[d.off]
    return pa.table(
        [pa.array(d.doc, pa.int64(), mask=d.null), pa.array(np.diff(d.off)), pa.array(np.diff(upto[d.off])), pa.array(np.diff(runs[d.off])), pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    docs: doc_id, text (null: empty) and other columns, which are ignored. Removed is each byte covered by a
    string of ``WIDTH`` bytes that also starts earlier: in a smaller doc_id, or earlier in the document. Rows
    that share a doc_id are documents of their own in order of their texts; a null doc_id comes before all
    others. Texts shorter than ``WIDTH`` bytes keep everything. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    dealt = whole_texts(docs).withColumn("sender", F.pmod(F.xxhash64("doc_id"), F.lit(SENDERS * n)).cast("int"))
    told = dealt.groupBy("sender").applyInArrow(tell_anchors(n), "owner int, sender int, n long, k int, blob binary")
    maps = told.groupBy("owner").applyInArrow(answer, "owner int, sender int, n long, shared binary, hot binary")
    sent = dealt.groupBy("sender").cogroup(maps.groupBy("sender")).applyInArrow(send_windows(n), "bucket int, sender int, done boolean, blob binary")
    marks = sent.groupBy("bucket").applyInArrow(compare, "sender int, blob binary")
    return dealt.groupBy("sender").cogroup(marks.groupBy("sender")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
