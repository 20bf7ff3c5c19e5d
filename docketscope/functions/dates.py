"""Dates kept as strings upstream: tolerant casts and deadline arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = str | dt.date | dt.datetime | Column | None

DATE_RANGE_DAYS = {"7d": 7, "30d": 30, "90d": 90, "365d": 365}

# Fixed values: (president, party, first day, day after the last).
ADMIN_ERAS = [
    ("Clinton", "D", "1993-01-20", "2001-01-20"),
    ("Bush II", "R", "2001-01-20", "2009-01-20"),
    ("Obama", "D", "2009-01-20", "2017-01-20"),
    ("Trump I", "R", "2017-01-20", "2021-01-20"),
    ("Biden", "D", "2021-01-20", "2025-01-20"),
    ("Trump II", "R", "2025-01-20", "2029-01-20"),
]


def to_day(c: Column) -> Column:
    return c.try_cast("date")


def to_instant(c: Column) -> Column:
    return c.try_cast("timestamp")


def as_instant(as_of: AsOf) -> Column:
    """The "now" of a query as a timestamp column."""
    if as_of is None:
        return F.current_timestamp()
    return (as_of if isinstance(as_of, Column) else F.lit(str(as_of))).cast("timestamp")


def as_day(as_of: AsOf) -> Column:
    return as_instant(as_of).cast("date")


def iso_day(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def window_open(end: Column, as_of: AsOf, is_open: bool = True) -> Column:
    """Comment window still open (or already closed); unknown ends are neither."""
    moment, now = to_instant(end), as_instant(as_of)
    return moment > now if is_open else moment < now


def _days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000)


def days_until(end: Column, as_of: AsOf) -> Column:
    """Whole days left, rounded up."""
    return F.ceil(_days_between(as_instant(as_of), to_instant(end))).cast("long")


def deadline_level(days: Column) -> Column:
    return F.when(days <= 3, "red").when(days <= 12, "amber").when(days.isNotNull(), "green")


def deadline_state(end: Column, as_of: AsOf) -> Column:
    """closed / red / amber / green, NULL when the end is unknown."""
    days = days_until(end, as_of)
    return F.when(days < 0, "closed").otherwise(deadline_level(days))


def deadline_text(end: Column, as_of: AsOf) -> Column:
    days = days_until(end, as_of)
    return (
        F.when(days < 0, "Comment period closed")
        .when(days <= 0, "Closes today")
        .when(days.isNotNull(), F.concat(days.cast("string"), F.lit("d left")))
    )


def recently_closed(end: Column, as_of: AsOf, within_days: int = 30) -> Column:
    passed = F.floor(_days_between(to_instant(end), as_instant(as_of)))
    return F.coalesce(passed.between(0, within_days), F.lit(False))


def period_days(start: Column, end: Column) -> Column:
    """Length of a comment window in days (at least 1); NULL when it is not a window."""
    s, e = to_instant(start), to_instant(end)
    return F.when(e > s, F.greatest(F.lit(1), F.round(_days_between(s, e)))).cast("long")


def period_elapsed(start: Column, end: Column, as_of: AsOf) -> Column:
    """Elapsed share of the window, clamped to 0..1; NULL when it is not a window."""
    s, e = to_instant(start), to_instant(end)
    share = _days_between(s, as_instant(as_of)) / _days_between(s, e)
    return F.when(e > s, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def era_of(day: Column, field: str = "president") -> Column:
    """Administration in office on a day: six fixed intervals, so no join is needed."""
    pick = {"president": 0, "party": 1}[field]
    tag = F.lit(None).cast("string")
    for era in reversed(ADMIN_ERAS):
        first, after = F.lit(era[2]).cast("date"), F.lit(era[3]).cast("date")
        tag = F.when((day >= first) & (day < after), era[pick]).otherwise(tag)
    return tag
