"""Name similarity in expressions: longest common subsequence, and ratios made of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


#: Characters that one word of the table's row stands for; sums of two words stay below the sign.
WORD = 61


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once, which an expression inside a lambda isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(chars: Column) -> Column:
    """Of each distinct character the places where it stands, as bits, ``WORD`` of them in a word."""
    words = F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / WORD).cast("int"))

    def bits(c: Column, k: Column) -> Column:
        part = F.slice(chars, k * WORD + 1, WORD)
        return F.aggregate(F.transform(part, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b))

    keys = F.array_distinct(chars)
    return F.map_from_arrays(keys, F.transform(keys, lambda c: F.transform(words, lambda k: bits(c, k))))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, a row of the table in bits: one step for each character of a."""
    full = F.lit((1 << WORD) - 1).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def step(row: Column, hits: Column) -> Column:
        def word(acc: Column, k: Column) -> Column:
            v = F.get(row, k)
            u = v.bitwiseAND(F.get(hits, k))
            added = v + u + acc["carry"]
            new = added.bitwiseAND(full).bitwiseOR(v - u)
            return F.struct(F.concat(acc["row"], F.array(new)).alias("row"), F.shiftright(added, WORD).alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("row"), zero.alias("carry"))
        return F.aggregate(F.sequence(F.lit(0), F.size(row) - 1), start, word, lambda acc: acc["row"])

    def over(places: Column, n: Column) -> Column:
        words = F.floor((n - 1) / WORD).cast("int") + 1
        known = F.filter(F.transform(_chars(a), lambda c: F.try_element_at(places, c)), lambda x: x.isNotNull())
        row = F.aggregate(known, F.array_repeat(full, words), step)
        return F.aggregate(row, F.lit(0), lambda acc, v: acc + WORD - F.bit_count(v)).cast("int")

    common = _let(_chars(b), lambda bs: _let(_places(bs), lambda places: over(places, F.size(bs))))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(common)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 x common subsequence over both lengths; 100 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(F.lit(200.0) * lcs_length(a, b) / F.nullif(total, F.lit(0)))


def sort_tokens(c: Column) -> Column:
    """Words in order, with single spaces."""
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sort_tokens(a), sort_tokens(b))
