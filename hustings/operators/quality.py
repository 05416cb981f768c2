"""Quality gates and quarantine: one tagged table, split by its rejection reason."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.operators.errors import DataQualityError, SamplingError

REASON = "_rejection_reason"


@dataclass(frozen=True)
class Split:
    clean: DataFrame
    rejected: DataFrame


def require_columns(df: DataFrame, names: Iterable[str], what: str, error: type[Exception] = DataQualityError) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise error(f"{what} lacks columns: {', '.join(missing)}")


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the share of nulls of each column; 0 for an empty table."""
    return df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(c) for c in columns])


def null_gate(df: DataFrame, columns: Sequence[str], most: float, what: str) -> None:
    """Fails if more than ``most`` of a column's values are null."""
    over = {c: r for c, r in null_rates(df, columns).first().asDict().items() if r > most}
    if over:
        raise DataQualityError(f"{what}: null rate over {most}: " + ", ".join(f"{c} {r:.4f}" for c, r in sorted(over.items())))


def tag(df: DataFrame, checks: Sequence[tuple[Column, str]], key: str | None, order: Sequence[Column | str], duplicate: str = "") -> DataFrame:
    """``_rejection_reason`` of each row, null for good ones.

    checks: (what is wrong, reason), the first that holds counts; a null condition is wrong as well. Among the
    rows that pass those before ``key``'s place (all of them), the first of each key by ``order`` stays.
    """
    reason = F.lit(None).cast("string")
    for wrong, text in reversed(checks):
        reason = F.when(F.coalesce(wrong, F.lit(True)), text).otherwise(reason)
    df = df.withColumn(REASON, reason)
    if key is None:
        return df
    # only good rows are ranked; the others, many of which may have no key, stay apart from each other
    df = df.withColumn("_apart", F.when(F.col(REASON).isNotNull(), F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy(key, "_apart").orderBy(*order))
    return df.withColumn(REASON, F.when(F.col(REASON).isNull() & (place > 1), duplicate).otherwise(F.col(REASON))).drop("_apart")


def split(tagged: DataFrame, clean_columns: Sequence[str] | None = None) -> Split:
    clean = tagged.filter(F.col(REASON).isNull()).drop(REASON)
    return Split(clean.select(*clean_columns) if clean_columns else clean, tagged.filter(F.col(REASON).isNotNull()))


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by ``order``, which must tell all rows of a key apart."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def require_unique(df: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    """The table, whose rows fail to be read if a key comes twice; the check costs no pass of its own."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit(f"{what}: key is not unique: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]))).cast("int")).otherwise(1)
    return df.withColumn("_unique", checked).filter("_unique = 1").drop("_unique")


def membership(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """A flag: the row's key is in ``keys``; a null key is not."""
    known = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(known, list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def reason_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(F.coalesce(REASON, F.lit("clean")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def require_files(paths: Iterable[str], exists) -> None:
    for p in paths:
        if not exists(p):
            raise FileNotFoundError(p)


__all__ = ["DataQualityError", "SamplingError", "Split", "tag", "split", "null_gate", "null_rates", "first_of", "require_unique", "require_columns", "membership", "reason_counts"]
