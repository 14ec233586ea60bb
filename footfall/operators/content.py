"""Which episodes and series earned most."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.dates import day_of
from footfall.functions.numbers import round_half_even
from footfall.functions.text import link, series_title
from footfall.operators.ordering import moving_average
from footfall.operators.pricing import PREVIEW_PRICE, preview_price


def episode_value(
    comments: DataFrame,
    episodes: DataFrame,
    key: str = "episode",
    ts: str = "comment_date",
    upload: str = "upload_at",
    preview: int = PREVIEW_PRICE,
) -> DataFrame:
    """Paid preview value per episode.

    The price of a comment depends on its episode and day alone, so comments
    are counted per (episode, day) before the join; a hot episode reaches the
    join as one row per day. Comments without an episode are left out.
    """
    per_day = comments.groupBy(key, day_of(F.col(ts)).alias("_day")).agg(
        F.count(F.lit(1)).alias("_comments")
    )
    columns = list(dict.fromkeys([key, "chapter", "episode", upload]))
    priced = per_day.join(episodes.select(*columns), key, "inner").withColumn(
        "_paid", F.col("_comments") * preview_price(F.col("_day"), F.col(upload), preview)
    )
    return (
        priced.dropna(subset=["chapter", "episode", upload])
        .groupBy("chapter", "episode", upload)
        .agg(F.sum("_paid").alias("total_cookie"))
    )


def value_trend(values: DataFrame, rows: int = 14, upload: str = "upload_at") -> DataFrame:
    """Episodes with the moving average of their value, in upload order."""
    return moving_average(values, "total_cookie", [upload, "chapter", "episode"], rows)


def mean_value(values: DataFrame) -> DataFrame:
    return values.agg(round_half_even(F.avg("total_cookie")).alias("mean_cookie"))


def top_episodes(
    values: DataFrame,
    snapshot: DataFrame,
    rows: int = 3,
    template: str | None = None,
) -> DataFrame:
    """The most valuable episodes that also appear in the snapshot.

    The join comes first, so an episode missing from the snapshot makes room
    for the next.
    """
    joined = values.join(snapshot, "episode", "inner")
    if template is not None:
        joined = joined.withColumn("link", link(template, F.col("chapter")))
    return joined.orderBy(F.desc("total_cookie"), "chapter", "episode").limit(rows)


def titled_values(
    values: DataFrame, short_titles: Mapping[int, int] | None = None
) -> DataFrame:
    return values.withColumn(
        "title", series_title(F.col("episode"), F.col("chapter"), short_titles)
    )


def series_summary(
    values: DataFrame, short_titles: Mapping[int, int] | None = None
) -> DataFrame:
    """Mean value and number of paid episodes per series title."""
    paid = titled_values(values, short_titles).filter(F.col("total_cookie") > 0)
    return (
        paid.filter(F.col("title").isNotNull())
        .groupBy("title")
        .agg(F.avg("total_cookie").alias("cookie_mean"), F.count("episode").alias("series_cnt"))
    )


def chart_points(table: DataFrame, x: str, y: str, identity: str) -> DataFrame:
    """One chart series as an ordered list of points, for a table of chart size.

    Everything meets in one row, so this belongs at the output, after the data
    has been cut to what a chart shows.
    """
    points = F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    return table.agg(F.lit(identity).alias("id"), points.alias("data"))


def chart_rows(placed: DataFrame, x: str, y: str, identity: str) -> DataFrame:
    """One chart series as rows (id, position, x, y), for tables of any size.

    `placed` carries its `position` in the order of the chart; dates are written
    as text, as charts take them.
    """
    return placed.select(
        F.lit(identity).alias("id"),
        "position",
        F.date_format(x, "yyyy-MM-dd").alias("x"),
        F.col(y).alias("y"),
    )
