"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each partition of a written digest table sorts its distinct 64-bit fingerprints and sends them, Rice-coded
   as gaps, to the owners of their ranges.
2. An owner merges what it gets and answers every sender with a bitmap of the fingerprints that others sent too.
3. Senders look their rows up in the bitmaps. Rows whose fingerprint was sent once are unique; the texts of the
   others, the suspects, are shuffled and grouped by their very bytes.

A sender has each fingerprint at most once, so a text that a third of all rows share costs an owner one entry
for each sender. Bytes are grouped with a partial aggregate before the shuffle for the same reason.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.encode import forget
from hustings.llm.store import materialise, partitions, whole_texts

U = np.uint64
#: The characters that texts may differ in.
SPACES = " \t\n\x0b\x0c\r"


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """(parameter, bytes) of sorted distinct unsigned 64-bit values: quotients in unary, remainders in binary."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=U(0))
    mean = max(1.0, float(values[-1]) / len(values))
    k = max(0, int(math.log2(mean * math.log(2)))) if mean > 1 else 0
    q = (gaps >> U(k)).astype(np.int64)
    ends = np.cumsum(q + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = (gaps[:, None] >> np.arange(k, dtype=U)[None, :]).astype(np.uint8) & 1 if k else np.zeros((len(gaps), 0), np.uint8)
    head = np.packbits(unary)
    return k, len(head).to_bytes(8, "little") + head.tobytes() + np.packbits(low.ravel()).tobytes()


def rice_decode(n: int, k: int, blob: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, U)
    size = int.from_bytes(blob[:8], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, 8)))[:n]
    q = np.diff(ends, prepend=-1) - 1
    gaps = q.astype(U) << U(k)
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=8 + size))[: n * k].reshape(n, k)
        gaps |= (bits.astype(U) << np.arange(k, dtype=U)[None, :]).sum(axis=1, dtype=U)
    return np.cumsum(gaps, dtype=U)


def _owner_starts(fps: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's range of the sorted fingerprints starts, and the end."""
    edges = np.array([(i << 64) // owners for i in range(owners)], U)
    return np.append(np.searchsorted(fps, edges), len(fps))


def send(owners: int):
    """A sender's coded ranges, for applyInArrow over its rows (sender, fp)."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        sender = table["sender"][0].as_py()
        fps = np.unique(table["fp"].to_numpy().view(U))
        at = _owner_starts(fps, owners)
        rows = []
        for o in range(owners):
            part = fps[at[o] : at[o + 1]]
            if len(part):
                base = U((o << 64) // owners)
                k, blob = rice_encode(part - base)
                rows.append((o, sender, len(part), k, blob))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["owner", "sender", "n", "k", "blob"])

    return run


def answer(owners: int):
    """An owner's bitmaps, one for each sender: set where another sender has the fingerprint as well."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        owner, senders = table["owner"][0].as_py(), table["sender"].to_pylist()
        base = U((owner << 64) // owners)
        parts = [rice_decode(n, k, b) + base for n, k, b in zip(table["n"].to_pylist(), table["k"].to_pylist(), table["blob"].to_pylist(), strict=True)]
        every, counts = np.unique(np.concatenate(parts), return_counts=True)
        more = every[counts > 1]
        maps = [np.packbits(np.isin(p, more, assume_unique=True)).tobytes() for p in parts]
        return pa.table([pa.array([owner] * len(senders), pa.int32()), pa.array(senders, pa.int32()), pa.array([len(p) for p in parts], pa.int64()), pa.array(maps, pa.binary())], names=["owner", "sender", "n", "bits"])

    return run


def suspect(rows: pa.Table, maps: pa.Table) -> pa.Table:
    """The sender's rows with a flag: its fingerprint is in more than one row anywhere."""
    fp = rows["fp"].to_numpy().view(U)
    fps, inverse, counts = np.unique(fp, return_inverse=True, return_counts=True)
    order = np.argsort(maps["owner"].to_numpy())
    bits = [np.unpackbits(np.frombuffer(maps["bits"][int(i)].as_py(), np.uint8))[: maps["n"][int(i)].as_py()] for i in order]
    flag = (np.concatenate(bits).astype(bool) if bits else np.zeros(len(fps), bool)) | (counts > 1)
    return rows.append_column("suspect", pa.array(flag[inverse]))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    docs: doc_id, text and any other columns, which are ignored. Texts are equal when identical without the
    characters of ``SPACES``; null and empty texts are equal to texts of spaces alone. Of equal texts the row
    with the most code points stays, then the smallest doc_id, then the first row of repeated ones; exactly one
    row of a group is kept. A null doc_id comes before all others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    owners = partitions(spark)
    texts = whole_texts(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.translate("text", SPACES, "").alias("norm"))
    rows = materialise(
        texts.select("doc_id", "n_chars", F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").alias("fp"), F.spark_partition_id().alias("sender"), F.monotonically_increasing_id().alias("row")), "digests"
    )
    sent = rows.select("sender", "fp").groupBy("sender").applyInArrow(send(owners), "owner int, sender int, n long, k int, blob binary")
    maps = sent.groupBy("owner").applyInArrow(answer(owners), "owner int, sender int, n long, bits binary")
    flagged = materialise(rows.groupBy("sender").cogroup(maps.groupBy("sender")).applyInArrow(suspect, "doc_id long, n_chars long, sha binary, fp long, sender int, row long, suspect boolean"), "flags")

    suspects = flagged.filter("suspect")
    ids = suspects.select(F.col("doc_id").alias("id")).distinct()
    bytes_ = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")
    checked = bytes_.groupBy("sha", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("sha").agg(F.count(F.lit(1)).alias("different"))
    best = F.min(F.struct((-F.col("n_chars")).alias("longest"), "doc_id", "row")).alias("best")
    classes = suspects.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), best)
    classes = classes.join(checked, "sha").select(
        "sha", F.when(F.col("different") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share a SHA-256")).cast("long")).alias("group_size"), "best"
    )
    # each sender asks once for a text, however often it has it, and its rows are joined with the answers by both
    asked = suspects.select("sender", "sha").distinct().join(classes, "sha")
    shared = suspects.join(asked, ["sender", "sha"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row"
    )
    alone = flagged.filter("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row")
    return shared.unionByName(alone).drop("row")
