"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_md5(sep: str, *parts: Column | str, missing: str = "") -> Column:
    """MD5 of the parts with a separator; a missing part has its own spelling, so places don't shift."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit(missing)) for p in parts]
    return F.md5(F.concat_ws(sep, *cols))


def leader_key(name: Column | str, commune: Column | str) -> Column:
    return joined_md5("|", name, commune)


def article_key(canonical: Column | str) -> Column:
    return joined_md5("", canonical)


def discovery_key(article: Column | str, provider: Column | str, outlet: Column | str, raw_path: Column | str, query: Column | str) -> Column:
    return joined_md5(":", article, provider, outlet, raw_path, query)


def snapshot_key(source: Column | str, iso_time: Column | str) -> Column:
    return joined_md5(":", source, iso_time)
