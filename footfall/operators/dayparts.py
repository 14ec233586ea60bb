"""When in the day users are active."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.numbers import share_percent

# Closed hour ranges; all other hours are night.
MORNING_HOURS = (6, 11)
DAY_HOURS = (12, 18)


def hourly_activity(log: DataFrame, ts: str = "ts") -> DataFrame:
    return log.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("cnt"))


def user_dayparts(
    log: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    morning: tuple[int, int] = MORNING_HOURS,
    day: tuple[int, int] = DAY_HOURS,
) -> DataFrame:
    hour = F.hour(ts)
    in_morning = hour.between(*morning)
    in_day = hour.between(*day)
    at_night = ~(in_morning | in_day)
    return log.groupBy(F.col(user).alias("user_id")).agg(
        F.count_if(in_morning).alias("morning"),
        F.count_if(in_day).alias("day"),
        F.count_if(at_night).alias("night"),
    )


def daypart_shares(parts: DataFrame) -> DataFrame:
    """Whole-percent share of each part of the day."""
    whole = F.col("morning") + F.col("day") + F.col("night")
    return parts.withColumns(
        {f"{part}_ratio": share_percent(F.col(part), whole) for part in ("morning", "day", "night")}
    )
