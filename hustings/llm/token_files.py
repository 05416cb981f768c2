"""Token-id output: documents' ids in ascending doc_id order, as Simple-8b blocks in shard files.

Texts are encoded where they are read, and only ids are shuffled, to the shard that holds their range of
doc_ids. A shard is one file of blocks, written by Spark's committer so that a lost executor leaves no half
file; its container is Parquet, one row for each block with the ids before it in the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm.encode import encoder, forget
from hustings.llm.simple8b import block, read_block
from hustings.llm.store import partitions, whole_texts
from hustings.llm.textops import steps

#: Pieces that a worker keeps here.
KEPT = 1_200_000
#: Ids after which a block ends with its document.
BLOCK = 1 << 14
#: n_null: documents at the start of the block that have no doc_id.
BLOCK_ROW = "shard int, block int, before long, n_ids long, n_docs int, n_null int, data binary"


def range_edges(docs: DataFrame, shards: int) -> list[float]:
    """Inner bounds of ranges of doc_id with about as many rows each."""
    if shards < 2:
        return []
    return sorted(set(docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / shards for i in range(1, shards)], 0.25 / shards)))


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where all of them fit."""
    a = np.frombuffer(ids, "<u4")
    return a.astype("<u2").tobytes() if a.max() < 65536 else ids


def _encode(path: str, end_id: int, edges: list[float]):
    bounds = np.array(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, KEPT), np.array([end_id], "<u4").tobytes()
        for part, _, _ in steps(batches):
            ids = [x + end for x in enc.encode(part["text"].to_pylist())]
            narrow = [_narrow(x) for x in ids]
            doc_ids = part["doc_id"].to_pandas().to_numpy(dtype=float, na_value=-np.inf)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.searchsorted(bounds, doc_ids, side="right"), pa.int32()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(narrow, pa.binary())], ["doc_id", "shard", "n", "ids"])

    return run


def _write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    doc_ids, lengths, held, total = [], [], [], 0
    shard = before = number = 0

    def flush() -> pa.RecordBatch:
        nonlocal doc_ids, lengths, held, total, before, number
        # null doc_ids come first
        data = block(np.array([d or 0 for d in doc_ids], np.int64), np.array(lengths), np.concatenate(held))
        row = pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([total], pa.int64()), pa.array([len(lengths)], pa.int32()), pa.array([doc_ids.count(None)], pa.int32()), pa.array([data], pa.binary())],
            ["shard", "block", "before", "n_ids", "n_docs", "n_null", "data"],
        )
        before, number = before + total, number + 1
        doc_ids, lengths, held, total = [], [], [], 0
        return row

    for batch in batches:
        for s, d, n, ids in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "n", "ids")), strict=True):
            if s != shard and held:
                yield flush()
            if s != shard:
                shard, before, number = s, 0, 0
            doc_ids.append(d)
            lengths.append(n)
            held.append(np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4"))
            total += n
            if total >= BLOCK:
                yield flush()
    if held:
        yield flush()


def write_token_files(docs: DataFrame, to: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Write the ids of docs, each document's followed by ``end_id``, in ascending doc_id order (null first, ids
    of repeated doc_ids in order of their bytes) to ``to``. Null texts are empty. Other columns are ignored."""
    spark = docs.sparkSession
    shards = shards or partitions(spark)
    texts = whole_texts(docs)
    edges = range_edges(texts, shards)
    coded = texts.mapInArrow(_encode(tokenizer, end_id, edges), "doc_id long, shard int, n long, ids binary")
    dealt = coded.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    dealt.mapInArrow(_write_blocks, BLOCK_ROW).write.option("compression", "none").parquet(to)


def _read_blocks(starts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for shard, before, nulls, data in zip(*(batch[c].to_pylist() for c in ("shard", "before", "n_null", "data")), strict=True):
                doc_ids, ends, ids = read_block(data)
                begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
                raw = ids.tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=np.arange(len(doc_ids)) < nulls), pa.array(begins + starts[shard] + before), pa.array(ends - begins, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files."""
    files = spark.read.schema(BLOCK_ROW).parquet(path)
    # one row for each shard; their number is a setting
    sizes = dict(files.groupBy("shard").agg(F.sum("n_ids")).collect())
    starts, total = {}, 0
    for shard in sorted(sizes):
        starts[shard] = total
        total += sizes[shard]
    return files.select("shard", "before", "n_null", "data").mapInArrow(_read_blocks(starts), "doc_id long, start long, n_tokens long, ids_crc32 long")
