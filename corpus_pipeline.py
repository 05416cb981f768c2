"""The corpus pipeline: documents that are fit for training, packed into sequences.

Each stage gets what the one before kept, as a table read from Parquet, and calls one operator. All stages but the last
return rows of their docs with the columns of docs, whatever else these are called. Null texts count as empty; an empty
table gives an empty one; rows are told apart by their texts where doc_ids repeat or are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.llm import decontaminate, exact_dedup, jaccard_join, packing, queries, toxicity
from hustings.llm.store import made, release, scratch

#: SQL has no word for the model, the tokenizer and the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it none of the columns of docs."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def _of(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose doc_id is (left_semi) or isn't (left_anti) in ``chosen``; null doc_ids are compared too."""
    ids: DataFrame = chosen.select(F.col("doc_id").alias(_free(docs, "_chosen_id"))).distinct()
    same: Column = docs["doc_id"].cast("long").eqNullSafe(ids[ids.columns[0]])
    return docs.join(ids, same, how)


def _repeated(docs: DataFrame) -> DataFrame:
    """doc_ids that more than one row has."""
    return docs.groupBy(F.col("doc_id")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")


def _without(spark: SparkSession, docs: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of docs but those that ``found`` returns the doc_ids of; rows that share a doc_id (null too) go each by its own text."""
    again = _repeated(docs)
    if again.isEmpty():
        return _of(docs, found(docs), "left_anti")
    # such rows are numbered, in a table so that the numbers stay, and looked at under their numbers
    path, row = scratch(spark, "repeated"), _free(docs, "_row")
    _of(docs, again, "left_semi").withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    gone = found(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("gone")).distinct()
    rows = rows.join(gone, rows[row] == gone["gone"], "left_anti").drop(row)
    once = _of(docs, again, "left_anti")
    return _of(once, found(once), "left_anti").unionByName(rows)


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (4): documents predicted toxic go, of rows that share a doc_id the toxic ones only.

    Empty texts are scored too; repeated rows have one score, so all of them stay or go. Whole texts are scored,
    however long. Without labels that can be learned from, nothing is predicted toxic but by the model's prior."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    return _without(spark, docs, lambda rows: toxicity.toxicity(rows, model).filter("predicted = 1"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (7): of equal texts the longest stays, then the least doc_id; of repeated rows one stays.

    Null and blank texts are equal to each other, so one of them stays; a null doc_id is less than all others."""
    kept = exact_dedup.exact_dedup(docs).filter("kept")
    again = _repeated(docs)
    if again.isEmpty():
        return _of(docs, kept, "left_semi")
    # rows that share a doc_id are told apart by their texts
    sha, place = _free(docs, "_sha"), _free(docs, "_place")
    named = kept.select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_sha"))
    norm = F.translate(F.coalesce(F.col("text"), F.lit("")), exact_dedup.SPACES, "")
    rows = _of(docs, again, "left_semi").withColumn(sha, F.unhex(F.sha2(norm, 256)))
    rows = rows.join(named, rows["doc_id"].cast("long").eqNullSafe(named["kept_id"]) & (rows[sha] == named["kept_sha"]), "left_semi")
    longest = Window.partitionBy("doc_id", sha).orderBy(F.length("text").desc_nulls_last())
    rows = rows.withColumn(place, F.row_number().over(longest)).filter(F.col(place) == 1).drop(place, sha)
    return _of(_of(docs, again, "left_anti"), kept, "left_semi").unionByName(rows)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (5), on five words and 0.8: of each component the least doc_id stays.

    Documents without words are linked with nothing and stay. Rows that share a doc_id, if their texts differ, stand
    or fall together from here on."""
    joined = jaccard_join.jaccard_join(docs, words=5, percent=80)
    return _of(docs, joined.filter("doc_id <=> component_id"), "left_semi")


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (6): documents with a verified test item go, of rows that share a doc_id those with one only.

    Empty texts are clean; without test items all documents stay. Texts are looked at whole."""
    items = queries.table(spark, sf_dir, "benchmark")
    return _without(spark, docs, lambda rows: decontaminate.contaminated(rows, items).filter(decontaminate.verified()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (10): pieces of at most 1024 ids with their sequence and offset.

    An empty text is a piece of the end id alone; repeated rows are packed as often as they come."""
    return packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", toxic_stage),
    ("exact_dedup", exact_stage),
    ("near_duplicates", near_stage),
    ("decontamination", leak_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read by the next."""
    docs, kept = queries.table(spark, sf_dir, "documents"), set(made(spark))
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        # the stage's own tables, and its input if a stage wrote it, have been read for the last time
        kept.add(path)
        release([x for x in made(spark) if x not in kept])
        kept.discard(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
