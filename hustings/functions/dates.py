"""Dates and times of feeds, requests and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feed_time(c: Column | str) -> Column:
    """RFC 2822, then ISO 8601; without a zone it is UTC; null if neither."""
    c = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    mail = F.regexp_replace(c, "^[A-Za-z]{3}, *", "")
    tries = [F.try_to_timestamp(F.when(mail.rlike(shape), mail), F.lit(p)) for p, shape in (("d MMM yyyy HH:mm:ss Z", r"[+-]\d{4}$"), ("d MMM yyyy HH:mm:ss z", r"[A-Z]{2,4}$"), ("d MMM yyyy HH:mm:ss", r"\d$"))]
    return F.coalesce(*tries, F.expr("try_cast(NULL AS TIMESTAMP)"), F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c)))


def event_time(c: Column | str) -> Column:
    """Compact UTC time of the event provider, such as 20260310T083000Z."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(F.when(c.rlike(r"^\d{8}T\d{6}Z$"), c), F.lit("yyyyMMdd'T'HHmmss'Z'"))


def api_time(c: Column | str) -> Column:
    """RFC 3339 time."""
    return F.try_to_timestamp(c)


def request_time(day: Column | str, end: bool = False) -> Column:
    """First or last second of a day in the request format."""
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("235959" if end else "000000"))


def partition_date(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(""))


def within(ts: Column | str, start: Column, end: Column) -> Column:
    """Whether the day is in the closed window; no day passes."""
    day = F.to_date(ts)
    return day.isNull() | day.between(start, end)


def fresh_enough(lastmod: Column | str, window_start: Column) -> Column:
    """Sitemap pruning: modified from the day before the window on, or not told."""
    day = F.to_date(lastmod)
    return day.isNull() | (day >= F.date_sub(window_start, 1))


def iso_utc(ts: Column | None = None) -> Column:
    """ISO 8601 in UTC with microseconds."""
    return F.date_format(F.current_timestamp() if ts is None else ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
