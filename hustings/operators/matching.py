"""Candidate against text: terms, signals, score and decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.config import ELECTION_KEYWORDS
from hustings.functions.text import aliases, any_token, family_given, match_tokens, normalize_match


def match_terms(cases: DataFrame) -> DataFrame:
    """The cases with the terms that texts are searched for, worked out once for each case."""
    a = aliases("full_name")
    family, given = family_given("full_name")
    variants = F.array_sort(F.array_distinct(F.filter(F.array(*[normalize_match(a[k]) for k in ("natural_accented", "natural_deaccented", "normalized")]), lambda x: x != "")))
    return cases.withColumns(
        {"full_name_variants": variants, "surname_tokens": match_tokens(family), "given_tokens": match_tokens(given), "commune_tokens": match_tokens(F.replace(F.col("commune_name"), F.lit("-"), F.lit(" ")))}
    )


@dataclass(frozen=True)
class Signals:
    """What of a candidate a normalised text has."""

    full_name: Column
    surname: Column
    given: Column
    commune: Column
    election: Column

    @property
    def score(self) -> Column:
        weights = ((self.full_name, 5), (self.surname, 2), (self.given, 1), (self.commune, 2), (self.election, 1))
        total = F.lit(0)
        for flag, w in weights:
            total = total + flag.cast("int") * w
        return total

    @property
    def matches(self) -> Column:
        """Names the candidate outright, or the surname together with given name or commune."""
        return self.full_name | (self.surname & (self.given | self.commune | (self.score >= 5)))

    @property
    def worth_reading(self) -> Column:
        """A match, or enough to read the article's text."""
        return self.matches | (self.election & (self.commune | self.surname)) | (self.score >= 3)


def signals(text: Column) -> Signals:
    """text: normalised for matching; the row has the columns of ``match_terms``."""
    return Signals(
        any_token(text, F.col("full_name_variants")), any_token(text, F.col("surname_tokens")), any_token(text, F.col("given_tokens")), any_token(text, F.col("commune_tokens")),
        F.lit(False) if not ELECTION_KEYWORDS else any_token(text, F.array(*[F.lit(k) for k in ELECTION_KEYWORDS])),
    )


#: Cases that one broadcast may hold; the cohort has a few dozen.
MOST_CASES = 10_000


def screen(entries: DataFrame, cases: DataFrame, text: Column) -> DataFrame:
    """Every entry against every case inside its window, with score, is_match and needs_verification.

    Containment of free tokens has no equi-key. The cohort is small by design and checked to be: it is broadcast,
    entries stay where they are, and a pair leaves the join only if the entry is worth a look.
    """
    n = cases.limit(MOST_CASES + 1).count()
    if n > MOST_CASES:
        raise ValueError(f"over {MOST_CASES} cases; match them in parts")
    from hustings.functions.dates import within

    terms = F.broadcast(match_terms(cases))
    s = signals(F.col("_text"))
    joined = entries.withColumn("_text", normalize_match(text)).join(terms, within("published_at", F.col("window_start"), F.col("window_end")) & s.worth_reading)
    return joined.withColumns({"score": s.score, "is_match": s.matches, "needs_verification": s.worth_reading}).drop("_text", "full_name_variants", "surname_tokens", "given_tokens", "commune_tokens")
