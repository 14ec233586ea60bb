"""Date parsing and calendar helpers on wall-clock timestamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text layouts accepted besides ISO, each with its ISO rewrite.
TIMESTAMP_LAYOUTS = (
    (r"^(\d{4})[./](\d{1,2})[./](\d{1,2})\.?$", "$1-$2-$3"),
    (r"^(\d{4})[./](\d{1,2})[./](\d{1,2})\.?\s+(\d{1,2}:\d{2}(?::\d{2})?)$", "$1-$2-$3 $4"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
)


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def week_start(day: Column) -> Column:
    """Monday of the calendar week."""
    return F.trunc(day, "WEEK")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def as_day(value) -> Column:
    """A date literal from a date or ISO text; columns pass through."""
    if isinstance(value, Column):
        return F.to_date(value)
    if isinstance(value, dt.datetime):
        value = value.date()
    if isinstance(value, dt.date):
        return F.lit(value)
    return F.to_date(F.lit(value))


def as_instant(value) -> Column:
    """A wall-clock timestamp literal; a bare date means its midnight."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.isoformat(" ") if isinstance(value, dt.datetime) else value.isoformat()
    return F.lit(value).cast("timestamp_ntz")


def digits_to_int(text: Column) -> Column:
    """All digits of the text as one integer; NULL when there are none."""
    return F.regexp_replace(text, r"[^0-9]", "").try_cast("int")


def lenient_timestamp(text: Column) -> Column:
    """Parse known layouts; anything else is NULL, a year or a month alone too.

    ISO text, the usual case, is parsed at once; only the rest is rewritten.
    """
    whole_day = F.trim(text).rlike(r"[0-9]+[^0-9]+[0-9]+[^0-9]+[0-9]|^[0-9]{8}")
    trimmed = F.when(whole_day, F.trim(text))
    rewritten = trimmed
    for pattern, iso in TIMESTAMP_LAYOUTS:
        rewritten = F.regexp_replace(rewritten, pattern, iso)
    return F.coalesce(trimmed.try_cast("timestamp_ntz"), rewritten.try_cast("timestamp_ntz"))


def resolve_comment_date(text: Column, load_day, days_ago_marker: str = "일 전") -> Column:
    """Absolute text, or "N days ago" counted back from the load day.

    Other relative forms, such as hours ago, do not parse and become NULL.
    """
    back = F.date_sub(as_day(load_day), digits_to_int(text)).cast("timestamp_ntz")
    return F.when(text.contains(days_ago_marker), back).otherwise(lenient_timestamp(text))


def strict_short_date(text: Column, max_year: int | None = None) -> Column:
    """Parse `yy.MM.dd`; bad text fails the job.

    Two-digit years always mean 20yy here. With `max_year`, later years fail
    too instead of landing decades ahead.
    """
    day = F.to_date(text, "yy.MM.dd")
    if max_year is None:
        return day
    problem = F.raise_error(F.concat(F.lit("upload year out of range: "), text)).cast("date")
    return F.when(F.year(day) > max_year, problem).otherwise(day)
