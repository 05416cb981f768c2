"""Best-fit packing of token sequences by minimum bin slack.

The plan needs only how many pieces there are of each length, at most ``capacity`` counts whatever the input:
a bin starts with the longest piece left, a bitset subset-sum over the lengths that are left finds the fullest
combination, and it is taken off, as often as the counts allow, since it stays the fullest until one of its
lengths runs out. Pieces then find their places by their rank among pieces of the same length: ranks within
a map task come from the task, those of the tasks before from a sum over (task, length) counts. So no task
gets the pieces of one length together, however many there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.encode import KEPT, encoder
from hustings.llm.store import materialise, whole_texts
from hustings.llm.textops import steps


@dataclass(frozen=True)
class Pattern:
    """``bins`` sequences from number ``first`` on, each holding items (length, copies, offset of the first)."""

    first: int
    bins: int
    items: tuple[tuple[int, int, int], ...]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, with the largest sum up to room; longer pieces are preferred."""
    lengths = sorted(n for n, c in counts.items() if c and n <= room)
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        stages.append(reach)
        left, k = min(counts[n], room // n), 1
        while left > 0:
            k = min(k, left)
            reach |= (reach << (n * k)) & mask
            left -= k
            k *= 2
    rest, taken = reach.bit_length() - 1, {}
    for n, before in zip(reversed(lengths), reversed(stages), strict=True):
        for c in range(min(counts[n], rest // n), -1, -1):
            if before >> (rest - n * c) & 1:
                break
        if c:
            taken[n] = c
            rest -= n * c
    return taken


def minimum_slack(counts: dict[int, int], capacity: int) -> list[Pattern]:
    left = {n: c for n, c in counts.items() if c > 0}
    plan, first = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        taken = fullest(left, capacity - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        bins = min(left[n] // c for n, c in taken.items())
        items, offset = [], 0
        for n in sorted(taken, reverse=True):
            items.append((n, taken[n], offset))
            offset += n * taken[n]
            left[n] -= bins * taken[n]
            if not left[n]:
                del left[n]
        plan.append(Pattern(first, bins, tuple(items)))
        first += bins
    return plan


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"


def _pieces(path: str, end_id: int, capacity: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, kept), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part, _, _ in steps(batches):
            rows, at, pieces, starts, lengths, crcs, ranks = 0, [], [], [], [], [], []
            for ids in enc.encode(part["text"].to_pylist()):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(rows)
                    pieces.append(i)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(ids[4 * a : 4 * b]))
                    ranks.append(seen[b - a])
                    seen[b - a] += 1
                rows += 1
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].take(pa.array(at)), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array([task] * len(at), pa.int32()), pa.array(ranks, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"],
            )

    return run


def _place(plan: list[Pattern]):
    """Sequence and offset of each piece from its length and its rank among all of that length."""
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for p in plan:
        for n, copies, offset in p.items:
            by_length.setdefault(n, []).append((p.first, p.bins, copies, offset))
    tables = {}
    for n, uses in by_length.items():
        first, bins, copies, offset = np.array(uses, np.int64).T
        tables[n] = (np.concatenate(([0], np.cumsum(bins * copies))), first, copies, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, place = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                edges, first, copies, offset = tables[int(n)]
                j = np.searchsorted(edges, rank[mine], side="right") - 1
                q = rank[mine] - edges[j]
                sequence[mine] = first[j] + q // copies[j]
                place[mine] = offset[j] + q % copies[j] * n
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(place)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, kept: int = KEPT) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id, text (null: empty, so the end id alone) and other columns, which are ignored. A document
    longer than ``capacity`` is cut from its end into pieces of that length; the first piece has the rest.
    Repeated rows are packed as often as they come, a null doc_id is kept, an empty table gives no rows. Pieces of one
    length are dealt to places in the order that tasks read them, so which of them lies where may differ from run to
    run; how many sequences there are, and what lengths each has, doesn't. A worker keeps the ids of ``kept`` pieces of text,
    which changes no result; more of them cost memory, and fewer are encoded again.
    """
    pieces = materialise(whole_texts(docs).mapInArrow(_pieces(tokenizer, end_id, capacity, kept), PIECE), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    by_task = materialise(by_task, "lengths")
    counts = {int(n): int(c) for n, c in by_task.groupBy("length").agg(F.sum("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    # a row for each task and length: they grow with the input and are not broadcast
    ranked = pieces.join(offsets.hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("task_rank")).alias("rank"))
    return ranked.mapInArrow(_place(minimum_slack(counts, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
