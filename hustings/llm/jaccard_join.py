"""N-gram Jaccard self-join by set-relation skipping, and the components of its links.

Equal sets are one class from the start, with one row each. A class's shingles are ordered by how common they
are, rare ones first by hash, so two similar sets share one of their first few (the prefix). From there on:

* Index lists. Prefixes are dealt by shingle; a list is sorted by set size, with the place of the shingle in
  each set. Blocks of a list whose sizes or places leave too little for the required overlap are skipped.
  Pairs left are held against each other's counts in ``CELLS`` parts of the hash range, a bound of the overlap,
  and only then against the sets themselves. Groups of a long list are first cut by the same counts into families.
* Answers from answers. A long list, that of a shingle common to a large group, is not paired. Its members are
  compared with a pivot, the list's least class. Jaccard distance is a metric: members that the pivot links are
  connected through it and need no comparison with each other, and of all others only those can be similar whose
  distances to the pivot differ by no more than the join's own distance. These are cut into shells by
  distance, and shells into blocks, and neighbouring blocks are joined. Within a block a set takes over answers
  that the same inequality decides from those of a set close to it.

No step gathers a group: memberships are (pivot, class) rows, and large groups are dealt in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.components import _least, components
from hustings.llm.encode import forget
from hustings.llm.store import materialise, partitions, release, whole_texts
from hustings.llm.textops import NOT_SPACE, U, mix, shingle_hashes, steps, word_bounds, word_hashes

#: Words of a shingle, and the similarity in hundredths.
WORDS, PERCENT = 4, 85
CELLS = 128
#: Shingles that have a place of their own in the order, at most; each costs 8 bytes of a broadcast.
COMMON = 1 << 18
#: A shingle in more different sets of one task than this is counted as a common one.
NOTICED = 1
#: Length beyond which a list has a pivot; counted sets beyond which a shingle's list is not gathered at all, its
#: pivot being the least class by a partial aggregate; members of a block.
LIST, HOT, BLOCK = 10, 64, 512
#: Buckets of index lists for each shuffle partition; a bucket's entries are held at once.
BUCKETS = 4
SHELL = 0.05


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def sets_of(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted, and where each document's start."""
    n = len(off) - 1
    start, end, doc = word_bounds(data, off, NOT_SPACE)
    s, d = shingle_hashes(word_hashes(data, start, end), doc, words, n)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (d[1:] != d[:-1]))) if len(s) else np.zeros(0, bool)
    return s[new], np.searchsorted(d[new], np.arange(n + 1))


def _count_common(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        for _, data, off in steps(batches):
            s, cut = sets_of(data, off, words)
            sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(s + U(1)), dtype=U)))
            _, one = np.unique(sums[cut[1:]] - sums[cut[:-1]], return_index=True)
            first = np.zeros(len(cut) - 1, bool)
            first[one] = True
            k, c = np.unique(s[np.repeat(first, np.diff(cut))], return_counts=True)
            k, c = k[c > 1], c[c > 1]
            keys, inverse = np.unique(np.concatenate((keys, k)), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate((counts, c)), minlength=len(keys)).astype(np.int64)
        keep = counts > NOTICED
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])], ["shingle", "n"])

    return run


def _signatures(words: int, percent: int, common: np.ndarray):
    """common: shingles in order from the least common; sorted copy and places are made once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        by_hash = np.argsort(common)
        known = common[by_hash]
        for part, data, off in steps(batches):
            s, cut = sets_of(data, off, words)
            n = np.diff(cut)
            doc = np.repeat(np.arange(len(n)), n)
            if len(known):
                i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                place = np.where(known[i] == s, by_hash[i] + 1, 0)
            else:
                place = np.zeros(len(s), np.int64)
            order = np.lexsort((s, place, doc))
            p = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
            cells = np.bincount(doc * CELLS + (s >> U(65 - CELLS.bit_length())).astype(np.int64), minlength=len(n) * CELLS).reshape(-1, CELLS)
            # 255 stands for any larger count, see _bound
            cells = np.minimum(cells, 255).astype(np.uint8)
            a, b = mix(s + U(1)), mix(s ^ U(0xA5A5A5A5A5A5A5A5))
            sums = [np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U))) for x in (a, b)]
            marks = np.stack([x[cut[1:]] - x[cut[:-1]] for x in sums], axis=1)
            s = s[order]
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"], pa.array(n), pa.array([m.tobytes() for m in marks], pa.binary()), pa.array([c.tobytes() for c in cells], pa.binary()),
                    pa.array([s[x : x + k].tobytes() for x, k in zip(cut[:-1], p, strict=True)], pa.binary()),
                ],
                ["doc_id", "n", "fp", "cells", "prefix"],
            )

    return run


def _coded(s: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray) -> bytes:
    """Entries in order of their nodes: 40 bits of the shingle, gaps of nodes, sizes and places, compressed."""
    low = (s >> U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    rest = np.diff(node, prepend=0).astype("<i8").tobytes() + n.astype("<u4").tobytes() + place.astype("<u4").tobytes()
    return len(s).to_bytes(8, "little") + low.tobytes() + zstandard.ZstdCompressor(level=3).compress(rest)


def _decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = int.from_bytes(blob[:8], "little")
    s = np.zeros((k, 8), np.uint8)
    s[:, :5] = np.frombuffer(blob, np.uint8, 5 * k, 8).reshape(-1, 5)
    rest = zstandard.ZstdDecompressor().decompress(blob[8 + 5 * k :])
    node = np.cumsum(np.frombuffer(rest, "<i8", k))
    return s.view("<u8").ravel(), node, np.frombuffer(rest, "<u4", k, 8 * k).astype(np.int64), np.frombuffer(rest, "<u4", k, 12 * k).astype(np.int64)


def _deal(buckets: int, hot: np.ndarray):
    """Prefix entries to buckets of the shingle's hash, but those of hot shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(hot)
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            s, node, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            to = (mix(s.copy()) % U(buckets)).astype(np.int64)
            order = np.lexsort((node, to))
            edges = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = [(b, _coded(*(x[order[edges[b] : edges[b + 1]]] for x in (s, node, n, place)))) for b in range(buckets) if edges[b] < edges[b + 1]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            s, row, place = _entries(batch)
            keep = ~_among(s, known)
            s, row, place = s[keep], row[keep], place[keep]
            if len(s):
                parts.append((s, batch["node"].to_numpy()[row], batch["n"].to_numpy()[row], place))
                held += len(s)
            if held > 1_000_000:
                yield flush()
                held = 0
        if parts:
            yield flush()

    return run


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, place in the prefix) of each prefix entry."""
    blobs = [np.frombuffer(b, U) for b in batch["prefix"].to_pylist()]
    size = np.array([len(b) for b in blobs], np.int64)
    s = np.concatenate(blobs) if blobs else np.zeros(0, U)
    return s, np.repeat(np.arange(len(size)), size), np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)


def _among(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(s), bool)
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s


def _hot_entries(hot: np.ndarray):
    """(shingle, node) of the prefix entries of hot shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(hot)
        for batch in batches:
            s, row, _ = _entries(batch)
            mine = _among(s, known)
            yield pa.RecordBatch.from_arrays([pa.array(s[mine].view(np.int64)), pa.array(batch["node"].to_numpy()[row[mine]])], ["shingle", "node"])

    return run


def _lists(percent: int):
    """A bucket's index lists: pairs of short ones after block skipping (kind 0), memberships of long ones with the
    pivot (1)."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        s, node, n, place = (np.concatenate(x) for x in zip(*(_decoded(b) for b in table["blob"].to_pylist()), strict=True))
        order = np.argsort(s, kind="stable")
        new = np.concatenate(([True], s[order[1:]] != s[order[:-1]], [True]))
        many = ~(new[1:] & new[:-1])
        order = order[many]
        s, node, n, place = s[order], node[order], n[order], place[order]
        order = np.lexsort((place, n, s))
        s, node, n, place = s[order], node[order], n[order], place[order]
        edges = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True]))) if len(s) else np.zeros(1, np.int64)
        sizes = np.diff(edges)
        found, members = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for size in np.unique(sizes):
            starts = edges[:-1][sizes == size]
            if size > LIST:
                for a in starts:
                    own = node[a : a + size]
                    members.append(np.stack((np.full(size, own.min()), own), axis=1))
                continue
            # one entry of each list of this length against the block of shorter sets before it
            for j in range(1, size):
                y = starts + j
                for i in range(j - 1, -1, -1):
                    x = starts + i
                    fits = 100 * n[x] >= percent * n[y]
                    if not fits.any():
                        # sets before are smaller still
                        break
                    ok = fits & (np.minimum(n[x] - place[x], n[y] - place[y]) >= needed(n[x], n[y], percent))
                    if ok.any():
                        found.append(np.stack((np.minimum(node[x[ok]], node[y[ok]]), np.maximum(node[x[ok]], node[y[ok]])), axis=1))
            if sum(map(len, found)) > 2_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
        parts = [np.unique(np.concatenate(x), axis=0) for x in (found, members)]
        rows = np.concatenate(parts)
        return pa.table([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(np.repeat([0, 1], [len(x) for x in parts]).astype(np.int8))], names=["hub", "node", "kind"])

    return run


def _bound(percent: int):
    """Drops pairs whose counts by cell can't give the overlap; the larger count stands for 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int64) for c in ("cells_a", "cells_b"))
            na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
            low = np.minimum(a, b)
            # a cell that is full in both may hold any number
            most = np.where(((a == 255) & (b == 255)).any(axis=1), np.minimum(na, nb), low.sum(axis=1))
            keep = most >= needed(na, nb, percent)
            yield batch.filter(pa.array(keep)).select(["hub", "node", "kind"])

    return run


def _families(percent: int):
    """Groups of a pivot that are small enough, cut into what their counts by cell leave connected: each family has
    its least class for a pivot, and members that no other can be similar to leave."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        table = table.sort_by([("hub", "ascending"), ("n", "ascending")])
        hub, node, n = (table[c].to_numpy() for c in ("hub", "node", "n"))
        cells = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int32)
        edges = np.flatnonzero(np.concatenate(([True], hub[1:] != hub[:-1], [True])))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(edges, edges[1:], strict=False):
            first, second = [], []
            for i in range(a, b - 1):
                # larger sets come later, those beyond the size bound are a run at the end
                stop = i + 1 + int(np.searchsorted(n[i + 1 : b], 100 * n[i] // percent, side="right"))
                rest = slice(i + 1, stop)
                most = np.minimum(cells[i], cells[rest]).sum(axis=1)
                full = ((cells[i] == 255) & (cells[rest] == 255)).any(axis=1)
                j = np.flatnonzero(full | (most >= needed(n[i], n[rest], percent)))
                first.append(np.full(len(j), node[i]))
                second.append(node[i + 1 + j])
            if first and sum(map(len, first)):
                members, least = _least(np.concatenate(first), np.concatenate(second))
                found.append(np.stack((least, members), axis=1)[members != least])
        rows = np.unique(np.concatenate(found), axis=0)
        return pa.table([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(np.ones(len(rows), np.int8))], names=["hub", "node", "kind"])

    return run


def _overlap(big: np.ndarray, small: np.ndarray) -> int:
    i = np.searchsorted(big, small)
    return int((big[np.minimum(i, len(big) - 1)] == small).sum()) if len(big) and len(small) else 0


def _held_sets(table: pa.Table, words: int) -> list[np.ndarray]:
    out = []
    for _, data, off in steps(table.select(["text"]).combine_chunks().to_batches()):
        s, cut = sets_of(data, off, words)
        out += [s[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    return out


def _against_hub(words: int):
    """Overlap of each member with the group's hub."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        sets = _held_sets(table, words)
        hub = sets[int(np.argmax(table["is_hub"].to_numpy()))]
        rows = [i for i, h in enumerate(table["is_hub"].to_pylist()) if not h]
        return pa.table(
            [table["hub"].take(pa.array(rows, pa.int64())), table["node"].take(pa.array(rows, pa.int64())), table["kind"].take(pa.array(rows, pa.int64())), pa.array([_overlap(hub, sets[i]) for i in rows], pa.int64()), pa.array([len(hub)] * len(rows), pa.int64()), pa.array([len(sets[i]) for i in rows], pa.int64())],
            names=["hub", "node", "kind", "both", "na", "nb"],
        )

    return run


def join_block(sets: list[np.ndarray], side: np.ndarray, linked: np.ndarray, pivot: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect members of different sides (all, if there is one), beyond what the pivot connects.

    pivot: distance to it. Members go in order of that distance, so the ones that it leaves possible are a run.
    Members that are connected already are not compared. A member that lies within a few hundredths of one that
    was answered leaves out those that the other's distances rule out.
    """
    far, slack = 1 - percent / 100, 1e-9
    order = np.argsort(pivot, kind="stable")
    found: list[tuple[int, int]] = []
    answered: list[tuple[int, dict[int, float]]] = []
    sizes = np.array([len(s) for s in sets])
    one_side = len(np.unique(side)) == 1
    # the pivot's members are one component from the start
    root = np.where(linked, int(np.flatnonzero(linked)[0]) if linked.any() else 0, np.arange(len(sets)))
    p = pivot[order]
    for at, i in enumerate(order):
        stop = int(np.searchsorted(p, pivot[i] + far + slack, side="right"))
        later = order[at + 1 : stop]
        later = later[100 * np.minimum(sizes[i], sizes[later]) >= percent * np.maximum(sizes[i], sizes[later])]
        if not one_side:
            later = later[side[later] != side[i]]
        later = later[root[later] != root[i]]
        if not len(later):
            continue
        near, known = 0.0, {}
        for _, answers in reversed(answered[-4:]):
            d = answers.get(int(i))
            if d is not None and d <= 0.05 and (not known or d < near):
                near, known = d, answers
        mine: dict[int, float] = {}
        for j in map(int, later):
            if root[j] == root[i] or (j in known and known[j] - near > far + slack):
                continue
            both = _overlap(sets[i], sets[j]) if sizes[i] >= sizes[j] else _overlap(sets[j], sets[i])
            union = int(sizes[i] + sizes[j]) - both
            mine[j] = 1 - both / union
            if 100 * both >= percent * union:
                found.append((int(i), j))
                root[root == root[j]] = root[i]
        if mine:
            answered.append((int(i), mine))
    return found


def _within_block(words: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        links = join_block(_held_sets(table, words), table["side"].to_numpy(), table["linked"].to_numpy(), table["distance"].to_numpy(), percent)
        a, b = ([node[x[k]] for x in links] for k in (0, 1))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (least doc_id reachable by links).

    docs: doc_id, text and other columns, which are ignored. Null, empty and blank texts have no shingles and no
    links; a text of fewer words than a shingle has one, of all of them. Equal sets are linked, repeated rows are
    returned as they come, a null doc_id has the component of the others it is linked with, or null. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    texts, passing = whole_texts(docs), []
    counted = materialise(texts.mapInArrow(_count_common(words), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "counts", passing)
    ranked = _most_common(counted, COMMON).toArrow()
    counts, common = ranked["n"].to_numpy(), ranked["shingle"].to_numpy().view(U)
    # from the least common
    order = np.lexsort((common, counts))
    hot, common = common[counts > HOT], common[order]

    signed = materialise(texts.mapInArrow(_signatures(words, percent, common), "doc_id long, n long, fp binary, cells binary, prefix binary"), "signatures")
    classes = signed.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("prefix").alias("prefix"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    cells = classes.select("node", "n", "cells")
    listed = classes.select("node", "n", "prefix").mapInArrow(_deal(BUCKETS * n, hot), "bucket int, blob binary").groupBy("bucket").applyInArrow(_lists(percent), "hub long, node long, kind byte")
    at_hot = classes.select("node", "prefix").mapInArrow(_hot_entries(hot), "shingle long, node long")
    # one row for each hot shingle at most
    pivots = at_hot.groupBy("shingle").agg(F.min("node").alias("hub"))
    members = at_hot.join(F.broadcast(pivots), "shingle").filter("hub <> node").select("hub", "node", F.lit(1).cast("byte").alias("kind"))
    pairs = listed.filter("hub <> node").unionByName(members).groupBy("hub", "node").agg(F.max("kind").alias("kind"))

    pairs = materialise(pairs, "candidates", passing)
    first = cells.select(F.col("node").alias("hub"), F.col("n").alias("na"), F.col("cells").alias("cells_a")).hint("merge")
    second = cells.select("node", F.col("n").alias("nb"), F.col("cells").alias("cells_b")).hint("merge")
    sized = pairs.filter("kind = 0").join(first, "hub").join(second, "node")
    likely = sized.mapInArrow(_bound(percent), "hub long, node long, kind byte")
    # sizes of groups, blocks and classes grow with the input: none of them is broadcast where it happens to be small
    groups = pairs.filter("kind = 1")
    groups = groups.join(groups.groupBy("hub").agg(F.count(F.lit(1)).alias("size")).hint("merge"), "hub")
    large = groups.filter(F.col("size") > BLOCK).select("hub", "node", "kind")
    small = groups.filter(F.col("size") <= BLOCK).select("hub", "node")
    # the hub comes along with its least member
    small = small.unionByName(small.groupBy("hub").agg(F.col("hub").alias("node")))
    families = small.join(cells.hint("merge"), "node").groupBy(F.pmod(F.xxhash64("hub"), F.lit(BUCKETS * n)).alias("bucket")).applyInArrow(_families(percent), "hub long, node long, kind byte")
    asked = materialise(likely.unionByName(large).unionByName(families).groupBy("hub", "node").agg(F.max("kind").alias("kind")), "pairs", passing)
    # a group is dealt in parts of about a block, each with the hub
    parts = asked.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    wanted = asked.join(parts.hint("merge"), "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "kind", F.lit(False).alias("is_hub"))
    wanted = wanted.unionByName(parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"), F.lit(0).cast("byte").alias("kind"), F.lit(True).alias("is_hub")))
    named = classes.select("node", "doc_id", "fp")
    text_of = texts.select("doc_id", "text")
    # repeated rows of a doc_id may differ, so a text is taken for its class by the class's own mark
    repeated = not signed.groupBy("doc_id").agg(F.min("fp").alias("one"), F.max("fp").alias("other")).filter("one <> other").isEmpty()
    if repeated:
        text_of = text_of.mapInArrow(_with_marks(words), "doc_id long, text string, fp binary")
        on = lambda t: (text_of.doc_id.eqNullSafe(t.doc_id)) & (text_of.fp == t.fp)
    else:
        on = lambda t: text_of.doc_id.eqNullSafe(t.doc_id)

    def with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
        named_rows = rows.join(named.hint("merge"), "node")
        found = text_of.join(named_rows.hint("merge"), on(named_rows)).select(*columns, text_of.text)
        return found.dropDuplicates(columns) if repeated else found

    grouped = with_text(wanted, ["hub", "part", "node", "kind", "is_hub"]).groupBy("hub", "part")
    answers = materialise(grouped.applyInArrow(_against_hub(words), "hub long, node long, kind byte, both long, na long, nb long"), "answers", passing)
    union = F.col("na") + F.col("nb") - F.col("both")
    answers = answers.withColumn("linked", 100 * F.col("both") >= percent * union).withColumn("distance", 1 - F.col("both") / union)
    links = answers.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))

    # what pivots leave open: members they don't link, and linked ones close enough to one of those
    around = answers.filter("kind = 1").select("hub", "node", "linked", "distance")
    open_ = around.groupBy("hub").agg(F.min(F.when(~F.col("linked"), F.col("distance"))).alias("nearest"), (F.count(F.lit(1)) <= BLOCK).alias("small")).filter("nearest IS NOT NULL")
    rest = around.join(open_.hint("merge"), "hub").filter(F.col("distance") >= F.when(F.col("linked"), F.col("nearest") - (1 - percent / 100) - 1e-9).otherwise(0))
    # a group of no more than a block is one shell: its distances are used within the block
    rest = materialise(rest.select("hub", "node", "linked", "distance", F.when(F.col("small"), 0).otherwise(F.floor(F.col("distance") / SHELL)).cast("int").alias("shell")), "rest", passing)
    if not rest.isEmpty():
        tiled = with_text(_tiles(rest, int(np.ceil((1 - percent / 100) / SHELL)) + 1), ["hub", "tile", "node", "linked", "distance", "side"]).groupBy("hub", "tile")
        links = links.unionByName(tiled.applyInArrow(_within_block(words, percent), "a long, b long"))

    # stars of pivots and connecting links of blocks: contracting them would cost each task another Python worker
    roots = components(links, contract=False)
    # the links are in the components' own table by now
    release(passing)
    labelled = classes.select("node", "fp", "doc_id").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = labelled.join(least.hint("merge"), "root").select("fp", "component_id")
    alone = signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return signed.filter("n > 0").select("doc_id", "n", "fp").join(by_set.hint("merge"), "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def _tiles(rest: DataFrame, reach: int) -> DataFrame:
    """A row for each member and each tile that it is in: a pair of blocks, (block of the lower shell, block of the upper).

    Shells are cut into blocks by a hash; blocks meet those of shells at most ``reach`` further, but for shells that
    the pivot links whole. A group has a bounded number of shells, so their sizes are one row of arrays."""
    shells = int(1 / SHELL) + 1
    of = lambda k, wanted: F.ceil(F.count(F.when((F.col("shell") == k) & wanted, 1)) / BLOCK).cast("int")
    shape = rest.groupBy("hub").agg(F.array(*[of(k, F.lit(True)) for k in range(shells)]).alias("blocks"), F.array(*[of(k, ~F.col("linked")) > 0 for k in range(shells)]).alias("open"))
    placed = rest.join(shape.hint("merge"), "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.get("blocks", F.col("shell"))).cast("int"))
    numbers = lambda k: F.when(F.get("blocks", k) > 0, F.sequence(F.lit(0), F.get("blocks", k) - 1)).otherwise(F.array().cast("array<int>"))
    meets = lambda k: F.get("open", k) | F.get("open", F.col("shell"))
    own = F.struct(F.col("shell").alias("shell"), F.col("block").alias("block"))
    other = lambda k, j: F.struct(k.alias("shell"), j.alias("block"))
    none = F.array().cast("array<struct<tile:struct<lower:struct<shell:int,block:int>,upper:struct<shell:int,block:int>>,side:int>>")
    tile = lambda lower, upper, side: F.struct(F.struct(lower.alias("lower"), upper.alias("upper")).alias("tile"), F.lit(side).alias("side"))
    up = F.transform(F.sequence(F.col("shell"), F.least(F.col("shell") + reach, F.lit(shells - 1))), lambda k: F.when(meets(k), F.transform(F.filter(numbers(k), lambda j: (k > F.col("shell")) | (j >= F.col("block"))), lambda j: tile(own, other(k, j), 0))).otherwise(none))
    down = F.transform(F.sequence(F.greatest(F.col("shell") - reach, F.lit(0)), F.col("shell")), lambda k: F.when(meets(k), F.transform(F.filter(numbers(k), lambda j: (k < F.col("shell")) | (j < F.col("block"))), lambda j: tile(other(k, j), own, 1))).otherwise(none))
    return placed.select("hub", "node", "linked", "distance", F.explode(F.concat(F.flatten(up), F.flatten(down))).alias("at")).select("hub", "node", "linked", "distance", "at.*")


def _most_common(counted: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the shingles (shingle, n) with the largest n; they are counted by size, not sorted."""
    size = F.floor(64 * F.log2("n"))
    by_size = counted.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("m")).collect()
    left, edge, share = most, -1, 1024
    for edge, m in sorted(map(tuple, by_size), reverse=True):
        if m > left:
            # of the last size a share by the hash that a shingle is
            share = 1024 * left // m
            break
        left -= m
    return counted.filter((size > edge) | ((size == edge) & (F.pmod("shingle", F.lit(1024)) < share)))


def _with_marks(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in steps(batches):
            s, cut = sets_of(data, off, words)
            a, b = mix(s + U(1)), mix(s ^ U(0xA5A5A5A5A5A5A5A5))
            sums = [np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U))) for x in (a, b)]
            marks = np.stack([x[cut[1:]] - x[cut[:-1]] for x in sums], axis=1)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text"], pa.array([m.tobytes() for m in marks], pa.binary())], ["doc_id", "text", "fp"])

    return run
