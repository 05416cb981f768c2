"""Connected components of a table of links, without gathering them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.store import release, scratch, ship


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of links held in one task."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars: each node with the least one that the task's links lead to."""
    held_a, held_b, held = [], [], 0
    for batch in batches:
        held_a.append(batch["a"].to_numpy())
        held_b.append(batch["b"].to_numpy())
        held += batch.num_rows
        if held > 2_000_000:
            n, m = _least(np.concatenate(held_a), np.concatenate(held_b))
            held_a, held_b, held = [n[n != m]], [m[n != m]], int((n != m).sum())
            if held > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held_a[0]), pa.array(held_b[0])], ["a", "b"])
                held_a, held_b, held = [], [], 0
    if held:
        n, m = _least(np.concatenate(held_a), np.concatenate(held_b))
        yield pa.RecordBatch.from_arrays([pa.array(n[n != m]), pa.array(m[n != m])], ["a", "b"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch without repeats; one that any of its rows says was moved is."""
    for batch in batches:
        if batch.num_rows:
            yield from pa.Table.from_batches([batch]).group_by(["a", "b"]).aggregate([("moved", "max")]).rename_columns(["a", "b", "moved"]).to_batches()


def components(links: DataFrame, contract: bool = True, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of ``links`` (a, b) can reach.

    A round has a large-star and a small-star step: a node's children are linked to its least neighbour, then a
    child's parents, and the child, to the least of them. A row says whether the round changed it, so the rounds end
    with one that changes nothing. Links are contracted within tasks first, if they aren't few already; a node's children are rows of a join that
    may be split and its parents at most one for each task, so a node with very many neighbours is not gathered.
    """
    spark = links.sparkSession
    ship(spark)
    links = links.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    links = links.mapInArrow(_contract, "a long, b long") if contract else links
    links, path = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(True).alias("moved")), None
    for _ in range(most_rounds):
        to = scratch(spark, "links")
        # one Python worker for each task in every stage
        (links.mapInArrow(_once, "a long, b long, moved boolean") if path else links).write.parquet(to)
        release([path])
        now, path = spark.read.schema("a long, b long, moved boolean").parquet(to), to
        if now.filter("moved").isEmpty():
            break
        # dealt by another expression than they were grouped by, so both sides of the join are exchanges, of which a
        # parent's many children can be split; as many rows as there are links, so they are not broadcast either
        up = now.groupBy("a").agg(F.min("b").alias("up")).select(F.bitwise_not("a").alias("parent"), "up")
        large = now.select("a", "b").withColumn("parent", F.bitwise_not("b")).join(up.hint("merge"), "parent", "left")
        large = large.select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved"))
        small = large.withColumn("least", F.min("b").over(Window.partitionBy("a")))
        small = small.withColumn("moved", F.col("moved") | (F.col("b") != F.col("least")))
        both = F.explode(F.array(F.struct("a", F.col("least").alias("b"), "moved"), F.struct(F.col("b").alias("a"), F.col("least").alias("b"), "moved")))
        links = small.select(both.alias("x")).select("x.*").filter("a <> b")
    else:
        raise RuntimeError("components did not settle")
    # each node below a root has one row by now
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
