"""Trailing actives kept up to date day by day.

The state holds one row per user with a bit for each recent day: bit k of `days` says
that the user was active k days before the state's day. A new day shifts the bits
and adds its users, so a day's report reads the state and one day of the log.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.dates import day_of

STATE = "user_id long, days long"
MOST_DAYS = 62


def _bits(log: DataFrame, as_of: dt.date, user: str, ts: str) -> DataFrame:
    """(user_id, days) of a log; equal days of a user are folded in the map tasks."""
    back = F.datediff(F.lit(as_of), day_of(F.col(ts)))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), back)
    return log.groupBy(F.col(user).alias("user_id")).agg(F.bit_or(one).alias("days"))


def advance(
    state: DataFrame | None,
    was: dt.date | None,
    log: DataFrame,
    as_of: dt.date,
    keep_days: int = 35,
    user: str = "user_id",
    ts: str = "ts",
) -> DataFrame:
    """The state as of a later day, with the new rows of the log.

    `state` is that of the day `was`, or None at the start. The log may hold rows of
    earlier days that came late; they set their bits as if they had come in time.
    Days are kept for `keep_days`; a row from before that, or from after `as_of`,
    raises, since a report it belongs to can no longer be put right, or not yet.
    Rows without a user or a time are left out; users without a kept day leave.
    """
    if not 1 <= keep_days <= MOST_DAYS:
        raise ValueError(f"keep_days must be between 1 and {MOST_DAYS}")
    if was is not None and as_of < was:
        raise ValueError("a state cannot go back")
    back = F.datediff(F.lit(as_of), day_of(F.col(ts)))
    told = F.concat(F.lit("a row is outside the days kept: "), F.col(ts).cast("string"))
    fits = F.when(back.between(0, keep_days - 1), True).otherwise(F.raise_error(told).cast("boolean"))
    fresh = _bits(log.filter(F.col(user).isNotNull() & F.col(ts).isNotNull()).filter(fits), as_of, user, ts)
    if state is None:
        return fresh
    moved = min((as_of - was).days, MOST_DAYS)
    kept = F.call_function("shiftleft", F.col("days"), F.lit(moved)).bitwiseAND(F.lit((1 << keep_days) - 1))
    older = state.select("user_id", kept.alias("days")).filter("days <> 0")
    return older.unionByName(fresh).groupBy("user_id").agg(F.bit_or("days").alias("days"))


def report(state: DataFrame, as_of: dt.date, days: int = 1, window: int = 7) -> DataFrame:
    """`date, dau, wau_trailing` for the last `days` days, from one pass over the state.

    A day is right as long as its whole window is kept. Days nobody was active on
    give no row, as in `trailing_stickiness`.
    """
    counts = []
    for back in range(days):
        seen = F.shiftright("days", back)
        counts.append(F.count_if(seen.bitwiseAND(F.lit(1)) != 0).alias(f"dau_{back}"))
        counts.append(F.count_if(seen.bitwiseAND(F.lit((1 << window) - 1)) != 0).alias(f"wau_{back}"))
    line = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(as_of - dt.timedelta(days=back)).alias("date"),
                    F.col(f"dau_{back}").alias("dau"),
                    F.col(f"wau_{back}").alias("wau_trailing"),
                )
                for back in range(days)
            ]
        )
    )
    return state.agg(*counts).select(line.alias("line")).select("line.*").filter("dau > 0")
