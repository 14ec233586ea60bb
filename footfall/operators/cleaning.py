"""From raw comments and episodes to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.dates import as_day, as_instant, resolve_comment_date, strict_short_date
from footfall.functions.text import leading_number


def clean_comments(
    raw: DataFrame,
    load_day,
    cutoff=None,
    date: str = "comment_date",
    days_ago_marker: str = "일 전",
) -> DataFrame:
    """Drop moderated rows, resolve dates, drop unparsed dates, apply the cutoff.

    The cutoff is an instant and inclusive: a bare date means its midnight, so
    later hours of that day are left out.
    """
    dated = raw.na.drop("any").withColumn(
        date, resolve_comment_date(F.col(date), load_day, days_ago_marker)
    )
    if cutoff is None:
        return dated.na.drop(subset=[date])
    # Unparsed dates are NULL and fail the comparison too.
    return dated.filter(F.col(date) <= as_instant(cutoff))


def between_days(df: DataFrame, day: str, start, end=None) -> DataFrame:
    """Inclusive day range; without an end it runs to the last day of the data."""
    chosen = F.col(day) >= as_day(start)
    if end is not None:
        chosen = chosen & (F.col(day) <= as_day(end))
    return df.filter(chosen)


def typed_episodes(
    raw: DataFrame,
    episode: str = "episode",
    upload: str = "upload_at",
    max_year: int | None = None,
) -> DataFrame:
    """Add `chapter` and turn the upload text into a date."""
    return raw.withColumn("chapter", leading_number(F.col(episode)).cast("long")).withColumn(
        upload, strict_short_date(F.col(upload), max_year)
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a fixed order.

    Spark cuts each key to one row before the shuffle (`WindowGroupLimit`), so
    a key with very many rows does not reach one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(window))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def snapshot(episodes: DataFrame, day: str, columns: list[str], down_at: str = "down_at") -> DataFrame:
    """Rows of one collection day, cut to the chosen columns."""
    return episodes.filter(F.col(down_at) == F.lit(day)).select(*columns)


def reproducible_sample(df: DataFrame, rows: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Exactly `rows` rows, chosen by a keyed hash.

    The choice does not depend on partitions or task attempts, and Spark keeps
    only the best rows of each task.
    """
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(mixed, *keys).limit(rows)


def preview(df: DataFrame, columns: list[str], rows: int, order: list[str]) -> DataFrame:
    """The first rows of a table in a fixed order, chosen columns only."""
    return df.orderBy(*order).select(*columns).limit(rows)
