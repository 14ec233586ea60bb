"""Active users by day, week, month and trailing window; stickiness.

Calendar-week and trailing-window actives are different numbers and carry
different names: `wau_calendar` and `wau_trailing`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.dates import day_of, month_start, week_start, weekday_name
from footfall.functions.numbers import percent_truncated, round_half_even, safe_ratio


def _user_periods(log: DataFrame, user: str, period, name: str) -> DataFrame:
    return log.select(F.col(user).alias("user_id"), period.alias(name)).dropna().distinct()


def user_days(log: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Distinct (user, day) pairs; duplicates fall away before the shuffle."""
    return _user_periods(log, user, day_of(F.col(ts)), "date")


def daily_active(log: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    daily = user_days(log, user, ts).groupBy("date").agg(F.count(F.lit(1)).alias("dau"))
    return daily.withColumn("day_name", weekday_name(F.col("date")))


def weekly_active(log: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    pairs = _user_periods(log, user, week_start(day_of(F.col(ts))), "week")
    return pairs.groupBy("week").agg(F.count(F.lit(1)).alias("wau_calendar"))


def monthly_active(log: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    pairs = _user_periods(log, user, month_start(day_of(F.col(ts))), "month")
    return pairs.groupBy("month").agg(F.count(F.lit(1)).alias("mau"))


def trailing_stickiness(
    log: DataFrame, user: str = "user_id", ts: str = "ts", window_days: int = 7
) -> DataFrame:
    """DAU, actives of the trailing window, and their ratio, per active day.

    A user active on day d counts for d .. d+window-1. Cutting each stretch
    short at the user's next active day makes the stretches disjoint, so plain
    counts replace the distinct count and the range join. The first day of a
    stretch is an active day, which gives the DAU in the same pass. A user has
    at most one row per calendar day here, whatever the size of their log.
    """
    own_days = Window.partitionBy("user_id").orderBy("date")
    last_day = F.least(
        F.date_add("date", window_days - 1), F.date_sub(F.lead("date").over(own_days), 1)
    )
    stretches = user_days(log, user, ts).withColumn("_last_day", last_day)
    covered = stretches.select(
        F.posexplode(F.sequence("date", "_last_day")).alias("offset", "date")
    )
    return (
        covered.groupBy("date")
        .agg(
            F.count_if(F.col("offset") == 0).alias("dau"),
            F.count(F.lit(1)).alias("wau_trailing"),
        )
        .filter(F.col("dau") > 0)
        .withColumn("stickiness", F.col("dau").cast("double") / F.col("wau_trailing"))
    )


def date_bounds(log: DataFrame, ts: str = "ts") -> DataFrame:
    day = day_of(F.col(ts))
    return log.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"))


def unique_users(log: DataFrame, user: str = "user_id") -> DataFrame:
    return log.agg(F.countDistinct(user).alias("unique_users"))


def first_activity_month(log: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    return log.groupBy(F.col(user).alias("user_id")).agg(
        F.date_format(F.min(ts), "yyyy-MM").alias("cohort_month")
    )


def mean_series(table: DataFrame, day: str, value: str) -> DataFrame:
    """Mean value per day: the series behind a line chart."""
    return table.groupBy(day).agg(F.avg(value).alias(value))


def days_with_week(log: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Each day's actives next to those of its calendar week.

    A user is new in a week on the first of their active days in it, so the
    weekly count is the sum of new users over the week's days. Both counts
    come from one pass over the distinct (user, day) pairs, without a join.
    """
    own_days = Window.partitionBy("user_id").orderBy("date")
    week = week_start(F.col("date"))
    marked = user_days(log, user, ts).withColumn(
        "_new", F.coalesce(F.lag("date").over(own_days) < week, F.lit(True))
    )
    daily = (
        marked.groupBy("date")
        .agg(F.count(F.lit(1)).alias("dau"), F.count_if("_new").alias("_new"))
        .withColumns({"day_name": weekday_name(F.col("date")), "week": week})
    )
    # At most seven rows per week.
    return daily.withColumn(
        "wau_calendar", F.sum("_new").over(Window.partitionBy("week"))
    ).drop("_new")


def week_gap(log: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sum of daily actives of a week, minus its weekly actives."""
    return (
        days_with_week(log, user, ts)
        .groupBy("week")
        .agg(F.sum("dau").alias("dau_sum"), F.max("wau_calendar").alias("wau_calendar"))
        .withColumn("dau_wau_diff", F.col("dau_sum") - F.col("wau_calendar"))
    )


def day_stickiness(log: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Whole-percent stickiness of each day against its calendar week."""
    ratio = F.col("dau").cast("double") / F.col("wau_calendar")
    return days_with_week(log, user, ts).withColumn("week_stick", percent_truncated(ratio))


def week_stickiness(stick: DataFrame, weekdays: list[str] | None = None) -> DataFrame:
    """Rounded mean of the day percents per week, for the chosen weekdays."""
    if weekdays is not None:
        stick = stick.filter(F.col("day_name").isin(weekdays))
    return stick.groupBy("week").agg(
        round_half_even(F.avg("week_stick")).alias("week_stick_mean")
    )


def overall_stickiness(weekly: DataFrame) -> DataFrame:
    """Rounded mean of the rounded weekly means, and the active days a week it implies."""
    mean = weekly.agg(round_half_even(F.avg("week_stick_mean")).alias("mean_stick"))
    return mean.withColumn(
        "days_per_week", safe_ratio(F.col("mean_stick"), F.lit(100)) * F.lit(7.0)
    )
