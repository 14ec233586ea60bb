"""Recency, frequency and monetary value per customer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.dates import as_day, day_of
from footfall.operators.pricing import PREVIEW_PRICE, preview_price


def first_activity(
    comments: DataFrame, keys: list[str], ts: str = "comment_date"
) -> DataFrame:
    """Day of the first comment per key.

    Only the day is needed downstream, so a minimum, combined before the
    shuffle, stands in for ranking the comments.
    """
    return comments.groupBy(*keys).agg(F.to_date(F.min(ts)).alias(ts))


def rfm_simple(
    comments: DataFrame,
    episodes: DataFrame,
    key: str = "episode",
    user: str = "user_id",
    ts: str = "comment_date",
    upload: str = "upload_at",
    preview: int = PREVIEW_PRICE,
) -> DataFrame:
    """One priced comment per (episode, user); tenure days, count and sum per user.

    `recency` is last minus first comment day. Episodes are joined as given,
    repeated keys included.
    """
    first = first_activity(comments, [key, user], ts)
    priced = first.join(episodes.select(key, upload), key, "inner").withColumn(
        "price", preview_price(F.col(ts), F.col(upload), preview)
    )
    return (
        priced.groupBy(user)
        .agg(
            F.min(ts).alias("first_comment_date"),
            F.max(ts).alias("last_comment_date"),
            F.count(F.lit(1)).alias("frequency"),
            F.sum("price").alias("monetary"),
        )
        .withColumn("recency", F.datediff("last_comment_date", "first_comment_date"))
    )


def last_day(log: DataFrame, ts: str = "ts") -> dt.date:
    """Observation end: the last day of the log.

    Read once, so that later plans hold a plain literal they can filter by.
    """
    found = log.agg(day_of(F.max(ts)).alias("last_day")).first()["last_day"]
    if found is None:
        raise ValueError("the log is empty")
    return found


def _daily_spend(transactions: DataFrame, user: str, ts: str, price: str) -> DataFrame:
    """Spend and rows per (user, day).

    Combined before the shuffle, so one very active user arrives as one row
    per day.
    """
    return transactions.groupBy(
        F.col(user).alias("user_id"), day_of(F.col(ts)).alias("_day")
    ).agg(F.sum(price).alias("_spend"), F.count(F.lit(1)).alias("_rows"))


def _mean_after_first(days: Column, spend: Column, first_spend: Column) -> Column:
    """Mean of the day sums without the first day; 0 for one-day customers."""
    rest = (spend - first_spend).cast("double") / (days - 1).cast("double")
    return F.when(days > 1, rest).otherwise(F.lit(0.0))


def rfm_repeat(
    transactions: DataFrame,
    observation_end,
    user: str = "user_id",
    ts: str = "ts",
    price: str = "price",
) -> DataFrame:
    """Repeat-purchase summary: frequency, recency, T, monetary_value.

    Active days count once; frequency leaves the first one out, and so does
    the mean of the day sums. Integer or decimal prices keep sums exact.
    """
    end = as_day(observation_end)
    daily = _daily_spend(transactions, user, ts, price).filter(F.col("_day") <= end)
    summary = daily.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_days"),
        F.min("_day").alias("_first"),
        F.max("_day").alias("_last"),
        F.sum("_spend").alias("_total"),
        F.min_by("_spend", "_day").alias("_first_spend"),
    )
    return summary.select(
        "user_id",
        (F.col("_days") - 1).alias("frequency"),
        F.datediff("_last", "_first").alias("recency"),
        F.datediff(end, "_first").alias("T"),
        _mean_after_first(F.col("_days"), F.col("_total"), F.col("_first_spend")).alias(
            "monetary_value"
        ),
    )


def repeat_state(
    transactions: DataFrame, user: str = "user_id", ts: str = "ts", price: str = "price"
) -> DataFrame:
    """One row per user that says all `rfm_repeat` needs of a part of the log.

    `user_id, days, first_day, last_day, total, first_spend`. Parts merge as long as a
    user's day lies in one part, so a part is some whole days of the log; rows
    without a time are left out.
    """
    daily = _daily_spend(transactions.filter(F.col(ts).isNotNull()), user, ts, price)
    return daily.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.min("_day").alias("first_day"),
        F.max("_day").alias("last_day"),
        F.sum("_spend").alias("total"),
        F.min_by("_spend", "_day").alias("first_spend"),
    )


def merge_states(*parts: DataFrame) -> DataFrame:
    """The state of all parts together, in any order.

    Stretches of days may interleave; the earliest first day keeps its spend. A
    day that two parts share as first or last day of a user raises, as it would
    count twice.
    """
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    ends = F.array_distinct(F.array("first_day", "last_day"))
    shared = (
        both.select("user_id", F.explode(ends).alias("day")).groupBy("user_id", "day").count().filter("count > 1")
    )
    clash = shared.first()
    if clash is not None:
        raise ValueError(f"day {clash['day']} of user {clash['user_id']} lies in two parts")
    return both.groupBy("user_id").agg(
        F.sum("days").alias("days"),
        F.min_by("first_spend", "first_day").alias("first_spend"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.sum("total").alias("total"),
    )


def rfm_of_state(state: DataFrame, observation_end) -> DataFrame:
    """`rfm_repeat` from a state whose days all lie up to the observation end."""
    end = as_day(observation_end)
    return state.select(
        "user_id",
        (F.col("days") - 1).alias("frequency"),
        F.datediff("last_day", "first_day").alias("recency"),
        F.datediff(end, "first_day").alias("T"),
        _mean_after_first(F.col("days"), F.col("total"), F.col("first_spend")).alias("monetary_value"),
    )


def calibration_holdout(
    transactions: DataFrame,
    observation_end,
    holdout_days: int = 30,
    user: str = "user_id",
    ts: str = "ts",
    price: str = "price",
) -> DataFrame:
    """Calibration summary and holdout outcome of each customer in one pass.

    Conditional aggregates replace the join of two summaries: customers
    without holdout rows get zeros, those first seen in the holdout drop out.
    The holdout value is a mean per row, not per day.
    """
    end = as_day(observation_end)
    split = F.date_sub(end, holdout_days)
    daily = _daily_spend(transactions, user, ts, price).filter(F.col("_day") <= end)
    early = F.col("_day") <= split
    cal_day = F.when(early, F.col("_day"))
    cal_spend = F.when(early, F.col("_spend"))
    late_spend = F.when(~early, F.col("_spend"))
    late_rows = F.when(~early, F.col("_rows"))
    summary = daily.groupBy("user_id").agg(
        F.count(cal_day).alias("_days"),
        F.min(cal_day).alias("_first"),
        F.max(cal_day).alias("_last"),
        F.sum(cal_spend).alias("_total"),
        F.min_by(cal_spend, cal_day).alias("_first_spend"),
        F.count(late_spend).alias("frequency_holdout"),
        F.sum(late_spend).alias("_late_total"),
        F.sum(late_rows).alias("_late_rows"),
    )
    return summary.filter(F.col("_days") > 0).select(
        "user_id",
        (F.col("_days") - 1).alias("frequency_cal"),
        F.datediff("_last", "_first").alias("recency_cal"),
        F.datediff(split, "_first").alias("T_cal"),
        _mean_after_first(F.col("_days"), F.col("_total"), F.col("_first_spend")).alias(
            "monetary_value_cal"
        ),
        "frequency_holdout",
        F.coalesce(
            F.col("_late_total").cast("double") / F.col("_late_rows").cast("double"), F.lit(0.0)
        ).alias("monetary_value_holdout"),
        F.lit(holdout_days).alias("duration_holdout"),
    )
