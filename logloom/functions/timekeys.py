"""Local-calendar keys over UTC instants (session time zone must be UTC)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def local(ts: Column, tz: str) -> Column:
    return ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)


def local_day(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(local(ts, tz), "yyyy-MM-dd")


def month_key(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(local(ts, tz), "yyyy-MM")


def week_key(ts: Column, tz: str = "UTC") -> Column:
    """ISO week, Monday first, numbered by the year of its Thursday."""
    at = local(ts, tz)
    year = F.date_part(F.lit("YEAROFWEEK"), at).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def utc_day(ts: Column) -> Column:
    """The rate date: prices are dated in UTC whatever zone the report groups in."""
    return F.to_date(ts)


TIME_KEYS = {"day": local_day, "week": week_key, "month": month_key}


def day_start(day: Column, tz: str = "UTC") -> Column:
    """UTC instant at which a local calendar day begins.

    A full instant (longer than a bare date) passes through. A midnight that
    does not exist resolves to the first instant of that day.
    """
    bare = F.to_utc_timestamp(F.to_timestamp(F.substring(day, 1, 10), "yyyy-MM-dd"), tz)
    return F.when(F.length(day) > 10, F.to_timestamp(day)).otherwise(bare)


def window_filter(ts: Column, since: str | None, until: str | None, tz: str = "UTC") -> Column:
    """since inclusive, until exclusive; bare dates are local midnights."""
    cond = F.lit(True)
    if since:
        cond = cond & (ts >= day_start(F.lit(since), tz))
    if until:
        cond = cond & (ts < day_start(F.lit(until), tz))
    return cond


def calendar_window(today: str, range_: str | None = None, since: str | None = None,
                    until: str | None = None) -> tuple[str | None, str | None]:
    """Named range or custom inclusive dates -> [since, until-exclusive) as days."""
    def shift(day: str, n: int) -> str:
        return (dt.date.fromisoformat(day) + dt.timedelta(days=n)).isoformat()

    if since or until:
        return since, shift(until, 1) if until else None
    span = {"7d": 7, "30d": 30, "90d": 90, "all": None}[range_ or "90d"]
    return (shift(today, 1 - span) if span else None), None


def calendar_window_columns(today: Column, days: int) -> tuple[Column, Column]:
    """The same window for a column of reference days: n days end with today."""
    return F.date_sub(today, days - 1), F.date_add(today, 1)


def millis_between(a: Column, b: Column) -> Column:
    return F.unix_millis(b) - F.unix_millis(a)
