"""The planned tier: exposure, lexicon counts, near-duplicate embeddings, tests and a count regression."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions.text import normalize_match


def exposure(mentions: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Articles, headline mentions and distinct sources of each leader; by 100,000 inhabitants if they are known.

    mentions: leader_id, article_id, domain, in_title. population: leader_id, population.
    """
    out = mentions.groupBy("leader_id").agg(F.count_distinct("article_id").alias("article_count"), F.count_if("in_title").alias("headline_mentions"), F.count_distinct("domain").alias("source_count"))
    if population is None:
        return out
    return out.join(population, "leader_id", "left").withColumn("articles_per_100k", F.col("article_count") * 100_000.0 / F.nullif(F.col("population"), F.lit(0)))


def lexicon_counts(texts: DataFrame, lexicon: Iterable[tuple[str, str]], key: str = "article_id", text: str = "body_text") -> DataFrame:
    """Occurrences of each category's words in each text, and by 1,000 words. lexicon: (category, word)."""
    by_word: dict[str, list[str]] = {}
    for category, word in lexicon:
        by_word.setdefault(word, []).append(category)
    if not by_word:
        by_word = {"": []}
    # texts are normalised and split once, and only words of the lexicon go on
    split = texts.select(key, F.filter(F.split(normalize_match(text), " "), lambda w: w != "").alias("_words"))
    rows = split.select(key, F.size("_words").alias("word_count"), F.explode("_words").alias("_word")).filter(F.col("_word").isin(*by_word))
    counts = rows.groupBy(key, "_word").agg(F.count(F.lit(1)).alias("count"), F.first("word_count").alias("word_count"))
    table = F.create_map(*[x for word, categories in by_word.items() for x in (F.lit(word), F.array(*[F.lit(c) for c in categories]).cast("array<string>"))])
    counts = counts.select(key, "count", "word_count", F.explode(F.try_element_at(table, F.col("_word"))).alias("category"))
    counts = counts.groupBy(key, "category").agg(F.sum("count").alias("count"), F.first("word_count").alias("word_count"))
    return counts.withColumn("per_1k_words", F.col("count") * 1000.0 / F.col("word_count"))


def bias_by_gender(facts: DataFrame, metric: str, group: str = "gender") -> DataFrame:
    """Mean of a metric by gender and the gap, in one row."""
    return facts.groupBy().pivot(group, ["F", "M"]).agg(F.avg(metric)).withColumn("gap", F.col("F") - F.col("M"))


def framing(facts: DataFrame, frames: Iterable[str]) -> DataFrame:
    """Mean probability of each frame for each leader."""
    return facts.groupBy("leader_id").agg(F.count(F.lit(1)).alias("mentions"), *[F.avg(f).alias(f) for f in frames])


#: Vectors of a tile: a task holds two tiles, and every vector travels once for each tile.
TILE = 16_384
#: Cells of the product that a task works out at once.
CELLS = 1 << 21
#: Cosines this near to the threshold, or to a tie of rounding, are summed again, in order: the product's last digits
#: hang on how it is blocked.
SLACK = 1e-9


def _tile_pairs(least: float, places: int | None):
    def vectors(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)

    def in_order(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = np.zeros(len(i))
        for c in v.T if len(i) else ():
            total += c[i] * c[j]
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        key = table.schema.field("id").type
        ids, tile, v = table["id"].to_numpy(), table["tile"].to_numpy(), vectors(table["v"])
        # powers of two change no digit of a cosine, and squares stay in range
        np.ldexp(v, -np.frexp(np.maximum(v.max(axis=1), -v.min(axis=1)))[1][:, None], out=v)
        square = np.zeros(len(v))
        for c in v.T:
            square += c * c
        finite = (square > 0) & np.isfinite(square)
        ids, tile, v, square = ids[finite], tile[finite], v[finite], square[finite]
        norm = np.sqrt(square)
        own = len(ids) == 0 or tile.min() == tile.max()
        if own and table["lo"][0].as_py() != table["hi"][0].as_py():
            return  # the other tile has no vectors
        left = np.arange(len(ids)) if own else np.flatnonzero(tile == tile.min())
        right = left if own else np.flatnonzero(tile == tile.max())
        step = max(1, CELLS // max(1, len(right)))
        for k in range(0, len(left), step):
            rows = left[k : k + step]
            product = v[rows] @ v[right].T
            i, j = np.nonzero(product >= ((least - SLACK) * norm[rows, None]) * norm[right])
            # within a tile every pair is seen from both sides
            x, y = ids[rows[i]], ids[right[j]]
            keep = x < y if own else x != y
            i, j, x, y = i[keep], j[keep], x[keep], y[keep]
            near, i, j = product[i, j], rows[i], right[j]
            # one root of both squares: by two roots a cosine may fall short of the threshold that it meets
            roots = np.sqrt(square[i] * square[j])
            near /= roots
            edge = near < least + SLACK
            if places is not None:
                shifted = near * 10.0**places
                edge |= np.abs(shifted - np.floor(shifted) - 0.5) < SLACK * 10.0**places
            edge = np.flatnonzero(edge)
            near[edge] = in_order(v, i[edge], j[edge]) / roots[edge]
            keep = near >= least
            x, y, near = x[keep], y[keep], near[keep]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.where(x < y, x, y), key), pa.array(np.where(x < y, y, x), key), pa.array(near)], ["a", "b", "similarity"])

    return run


def embedding_pairs(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", places: int | None = None) -> DataFrame:
    """All pairs (a < b) of vectors whose cosine is ``least`` or more, of any label: every pair is compared.

    At a low threshold bands of signs rule out little (0.9 of the pairs at 0.3 would take some 140 bands of 8 signs),
    so the product is taken whole, in pairs of tiles; cosines at the threshold are summed in order, as SQL does, and so
    are those at a tie of ``places`` decimals, to which the caller rounds.
    Null keys and vectors that are null, empty, zero, not finite or have a null are in no pair; vectors of different
    lengths have no cosine.
    """
    usable = F.col(key).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    rows = vectors.filter(usable).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.size(vector).alias("dims"))
    tiles = max(1, math.ceil(rows.count() / TILE))
    own = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    dealt = rows.withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.select("dims", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "id", "tile", "v")
    kind = vectors.schema[key].dataType.simpleString()
    return dealt.groupBy("dims", "lo", "hi").applyInArrow(_tile_pairs(least, places), f"a {kind}, b {kind}, similarity double")


#: Ranges of values that ranks are worked out in.
RANGES = 64


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """One row: chi-square statistic and degrees of freedom of a contingency table."""
    cells = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    rows, columns = cells.groupBy(row).agg(F.sum("n").alias("r")), cells.groupBy(column).agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum("n").alias("t"), F.count_distinct(row).alias("nr"), F.count_distinct(column).alias("nc"))
    # each table holds a row for each category of one column
    full = cells.join(rows, row).join(columns, column).join(F.broadcast(total))
    expected = F.col("r") * F.col("c") / F.col("t")
    seen = full.agg(F.sum((F.col("n") - expected) ** 2 / expected + 0.0).alias("seen"), F.sum(expected).alias("covered"), F.first("t").alias("t"), F.first("nr").alias("nr"), F.first("nc").alias("nc"))
    # cells without a row add their expectation, all of which sum up to the total
    return seen.select((F.col("seen") + F.col("t") - F.col("covered")).alias("statistic"), ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("degrees"))


def mann_whitney(df: DataFrame, group: str, value: str, first: object, second: object) -> DataFrame:
    """One row: U of the first group against the second, ties at half; ranks come from counts of distinct values.

    Values, which are numbers, are cut into ``RANGES`` of about as many each; sums within a range and sums of the
    ranges before it make the rank, so no task has all values. Rows without a value don't count.
    """
    values = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull())
    by_value = values.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == first).alias("n1"), F.count_if(F.col(group) == second).alias("n2"))
    edges = sorted(set(by_value.select(F.col("v").cast("double")).approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))))
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e <= F.col("v"))) if edges else F.lit(0)
    placed = by_value.withColumn("part", part)
    sums = placed.groupBy("part").agg(F.sum("n2").alias("own"))
    # one row for each range
    sums = sums.select("part", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    below = F.col("earlier") + F.coalesce(F.sum("n2").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = F.col("n1") * (below + F.col("n2") / 2)
    return placed.join(F.broadcast(sums), "part").withColumn("u", u).agg(F.sum("u").alias("u"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))


def poisson_regression(df: DataFrame, target: str, features: list[str], offset: str | None = None):
    """A Poisson model of counts with a log link, fitted on the executors."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    ready = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_features", labelCol=target, maxIter=50)
    return (model.setOffsetCol(offset) if offset else model).fit(ready)
