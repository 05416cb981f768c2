"""Queries of this subpackage by name, and the SQL that their rows are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm import decontaminate, exact_dedup, jaccard_join, license_scan, packing, quality, secret_scan, suffix_dedup, token_files, toxicity
from hustings.llm.store import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), to, tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, to)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verified pairs: a document that is in none is clean."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.filter(decontaminate.verified())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, after a version of the table that had about half of them: the second scan reads what the ledger lacks."""
    docs = table(spark, sf_dir, "documents")
    earlier = docs.filter(F.xxhash64("doc_id") < 0)
    return secret_scan.digest(secret_scan.scan_history([earlier, docs], scratch(spark, "ledger")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024, kept=token_files.KEPT)


def secret_sql(rules: tuple[secret_scan.Rule, ...] = secret_scan.RULES) -> str:
    """The scan in SQL: starts are the lengths of gaps and matches before, summed."""
    parts = []
    for place, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {place} AS place, {r.base} AS base, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS whole, regexp_extract_all(t, '{p}', {r.group}) AS val, string_split_regex(t, '{p}') AS gap FROM d WHERE regexp_matches(t, '{p}')"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    n = [r.kind for r in rules if r.base]
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
        x AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m),
        y AS (SELECT doc_id, kind, place, base, length(val[i]) >= least AS counted, length(whole[i]) AS span,
                     list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: length(g))), 0) AS first FROM x),
        z AS (SELECT *, concat(kind, ':', CAST(first AS BIGINT), ':', CAST(first + span AS BIGINT)) AS text FROM y WHERE counted),
        s AS (SELECT doc_id, {counts}, string_agg(text, ',' ORDER BY first, place) FILTER (base) AS own, string_agg(text, ',' ORDER BY first, place) AS spans FROM z GROUP BY doc_id)
        SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in n)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s ON d.doc_id = s.doc_id
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_token_files": op3_token_files,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op5_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        u AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS shingle FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_have >= 85 * (a.n + b.n - both_have)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
    """,
    "op8_secret_scan": secret_sql(),
}
