"""Request windows: tumbling, daily, and those of providers that need more than a day."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.config import DEFAULTS


def request_windows(bounds: DataFrame, days: int = 7, start: str = "window_start", end: str = "window_end") -> DataFrame:
    """Windows of some days from start on, the last one clipped to the end; both ends are inside."""
    at = F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"interval {days} days")))
    return bounds.withColumn("request_start", at).withColumn("request_end", F.least(F.date_add("request_start", days - 1), F.col(end)))


def split_near_cap(windows: DataFrame, hits: Column, cap: int = DEFAULTS.gdelt_max_records, share: float = DEFAULTS.gdelt_near_cap) -> DataFrame:
    """Windows that answered with nearly as many records as a request can give, day by day; others as they are."""
    full = hits >= int(cap * share)
    span = F.when(full & (F.col("request_end") > F.col("request_start")), F.sequence("request_start", "request_end", F.expr("interval 1 day"))).otherwise(F.array("request_start"))
    day = windows.withColumn("_full", full).withColumn("_day", F.explode(span))
    return day.withColumn("request_end", F.when(F.col("_full"), F.col("_day")).otherwise(F.col("request_end"))).withColumn("request_start", F.col("_day")).drop("_day", "_full")


def resolve_window(start: date | None, end: date | None, alias_start: date | None = None, alias_end: date | None = None) -> tuple[date, date]:
    """Aliases win over the named bounds, those over the analysis window."""
    first = alias_start or start or date.fromisoformat(DEFAULTS.analysis_start_date)
    return first, alias_end or end or date.fromisoformat(DEFAULTS.analysis_end_date)


def provider_window(provider: str, start: date, end: date) -> tuple[date, date]:
    """The keyed search API takes a day more in front where the window is one day long."""
    return (start - timedelta(days=1), end) if provider == "gnews" and end - start == timedelta(days=1) else (start, end)


def provider_start(provider: Column, start: Column, end: Column) -> Column:
    """``provider_window`` as an expression."""
    return F.when((provider == "gnews") & (F.datediff(end, start) == 1), F.date_sub(start, 1)).otherwise(start)


def daily_window(day: date | None = None, now: datetime | None = None, lookback: int = 0) -> tuple[date, date]:
    """A day and the next one, yesterday in UTC unless it is named; the slow provider looks back some days more."""
    day = day or ((now or datetime.now(UTC)).astimezone(UTC).date() - timedelta(days=1))
    return day - timedelta(days=lookback), day + timedelta(days=1)
