"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is content-addressed by SHA-256. A blob is scanned once for each rule
version: pairs that the ledger already holds are left out by an anti join, the rest are scanned,
and the findings are joined back to every path (document) with that content.

Positions come from Spark's own regex functions: the lengths of the gaps that ``split`` leaves and
of the matches that ``regexp_extract_all`` finds, summed in order by a window over a blob's matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.llm.store import materialise, whole_texts


@dataclass(frozen=True)
class Rule:
    """group: the group whose length counts; least: its least length; version: raise it when the pattern changes."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = False


#: The first three are the contract's, in its order.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 1),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)

SEEN = "blob binary, rule string, version int"
FINDINGS = "blob binary, rule string, version int, first long, last long"
NO_HITS = "array<struct<rule:int,n:int,gap:int,span:int,counted:boolean>>"


def blobs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, blobs): doc_id with its content's address, and each distinct content once."""
    texts = whole_texts(docs).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("blob"))
    paths = texts.select("doc_id", "blob")
    # one id of each content is elected first, so a text is never sorted or grouped by a hot key
    chosen = paths.groupBy("blob").agg(F.min("doc_id").alias("chosen")).withColumnRenamed("blob", "chosen_blob")
    once = texts.join(chosen, texts.doc_id.eqNullSafe(chosen.chosen) & (texts.blob == chosen.chosen_blob)).select("blob", "text")
    return paths, once


def _hits(rule: Rule, index: int) -> Column:
    """The blob's matches of one rule in order, those that fail its least length too: they move the later ones."""
    pattern = F.lit(rule.pattern)
    gaps = F.split("text", rule.pattern, -1)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    values = F.regexp_extract_all("text", pattern, F.lit(rule.group))
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("span"), values.alias("value")),
        lambda x, n: F.struct(F.lit(index).alias("rule"), n.alias("n"), F.length(x["gap"]).alias("gap"), F.length(x["span"]).alias("span"), (F.length(x["value"]) >= rule.least).alias("counted")),
    )
    wanted = F.col("rules").bitwiseAND(F.lit(1 << index)) != 0
    return F.when(wanted & F.col("text").rlike(rule.pattern), rows).otherwise(F.array().cast(NO_HITS))


def unseen(once: DataFrame, rules: tuple[Rule, ...], seen: DataFrame | None) -> DataFrame:
    """blob, text and ``rules``, a bit for each rule whose present version has not read the blob yet."""
    every = (1 << len(rules)) - 1
    if seen is None:
        return once.withColumn("rules", F.lit(every))
    bit = F.lit(0)
    for i, r in enumerate(rules):
        bit = F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), 1 << i).otherwise(bit)
    known = seen.groupBy("blob").agg(F.bit_or(bit).alias("known"))
    todo = once.join(known, "blob", "left").withColumn("rules", F.lit(every).bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0)))))
    return todo.filter("rules != 0").drop("known")


def scan(todo: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (blob, rule, version, first, last) of the pairs of blob and rule version in ``todo``."""
    # distinct: equal rows come from repeated rows of one document
    hits = todo.select("blob", F.explode(F.concat(*[_hits(r, i) for i, r in enumerate(rules)])).alias("x")).select("blob", "x.*").distinct()
    upto = Window.partitionBy("blob", "rule").orderBy("n")
    placed = hits.withColumn("last", F.sum(F.col("gap").cast("long") + F.col("span")).over(upto))
    kinds, versions = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.version) for r in rules])
    return placed.filter("counted").select(
        "blob", F.get(kinds, F.col("rule")).alias("rule"), F.get(versions, F.col("rule")).alias("version"), (F.col("last") - F.col("span")).alias("first"), "last"
    )


@dataclass
class Ledger:
    """seen: (blob, rule, version) pairs that were scanned; findings: (blob, rule, version, first, last)."""

    seen: DataFrame
    findings: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> Ledger:
        """The ledger below a folder of the shared store; one that was never written is empty."""
        tables = []
        for name, schema in (("seen", SEEN), ("findings", FINDINGS)):
            try:
                tables.append(spark.read.schema(schema).parquet(f"{path}/{name}"))
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                tables.append(spark.createDataFrame([], schema))
        return Ledger(*tables)

    def append(self, path: str) -> None:
        """Add these rows to the ledger below the folder: findings first, so that a pair counts as seen only when they are there.
        A run that is lost in between is scanned again, and its findings count once."""
        self.findings.write.mode("append").parquet(f"{path}/findings")
        self.seen.write.mode("append").parquet(f"{path}/seen")


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> tuple[DataFrame, Ledger]:
    """(findings by path, what this scan adds to the ledger).

    docs: doc_id, text (null: empty) and any other columns, which are ignored. Findings by path: doc_id, blob
    and ``found``, the sorted array of (first, place of the rule, kind, last) in code points, last exclusive.
    Documents without findings have an empty array, repeated rows are returned as often as they come, a null
    doc_id is kept, and an empty table gives empty results. The ledger may hold contents of other tables and
    other rule versions; only findings of the present versions are reported.
    """
    paths, once = blobs(docs)
    todo = unseen(once, rules, ledger and ledger.seen)
    fresh = scan(todo, rules)
    if ledger is not None:
        fresh = materialise(fresh, "findings")
    whole = fresh if ledger is None else ledger.findings.unionByName(fresh)
    place, current = F.lit(None).cast("int"), F.lit(False)
    for i, r in enumerate(rules):
        same = F.col("rule") == r.kind
        place, current = F.when(same, i).otherwise(place), current | (same & (F.col("version") == r.version))
    by_blob = whole.filter(current).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("first", place.alias("place"), F.col("rule").alias("kind"), "last"))).alias("found"))
    nothing = F.array().cast(by_blob.schema["found"].dataType)
    pairs = F.array(*[F.when(F.col("rules").bitwiseAND(F.lit(1 << i)) != 0, F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))) for i, r in enumerate(rules)])
    seen = todo.select("blob", F.explode(F.array_compact(pairs)).alias("x")).select("blob", "x.*")
    return paths.join(by_blob, "blob", "left").withColumn("found", F.coalesce("found", nothing)), Ledger(seen, fresh)


def scan_history(versions: list[DataFrame], path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings by path of the last of several versions of a table (see ``secret_scan``), oldest first.

    Each version is scanned against the ledger below ``path`` and adds to it, so a content that several versions
    or paths have, or that an earlier run has read, is scanned once for each version of a rule."""
    found = None
    for docs in versions:
        found, new = secret_scan(docs, rules, Ledger.read(docs.sparkSession, path))
        new.append(path)
    return found


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, span lists and the hash of the base spans for each path."""
    base = [r.kind for r in rules if r.base]
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))), ",")
    is_kind = lambda k: lambda x: x["kind"] == k
    only = F.filter("found", lambda x: x["kind"].isin(base))
    return found.select(
        "doc_id",
        *[F.size(F.filter("found", is_kind(k))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(text(only), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )
