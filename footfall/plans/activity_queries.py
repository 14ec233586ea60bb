"""Active users, stickiness and time of day over the event log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from footfall.operators import activity, cleaning, content, daily_state, dayparts
from footfall.plans.bindings import events
from footfall.plans.registry import query
from footfall.session import materialise

RELEASE_DAYS = ["Sunday", "Wednesday"]
RANGE_START, RANGE_END = "2024-01-08", "2024-01-21"

DAILY_SQL = """
daily AS (
  SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS dau,
         dayname(CAST(ts AS DATE)) AS day_name
  FROM events GROUP BY CAST(ts AS DATE))"""

# As many days as the kept ones of a state cover with their whole window.
REPORTED_DAYS = 25

TRAILING_SQL = f"""{DAILY_SQL},
trailing_week AS (
  SELECT d.date, count(DISTINCT e.user_id) AS wau_trailing
  FROM daily d JOIN events e
    ON CAST(e.ts AS DATE) BETWEEN d.date - 6 AND d.date
  GROUP BY d.date)"""

WEEK_SQL = f"""{DAILY_SQL},
weekly AS (
  SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT user_id) AS wau_calendar
  FROM events GROUP BY 1),
day_week AS (
  SELECT d.*, w.week, w.wau_calendar FROM daily d
  JOIN weekly w ON CAST(date_trunc('week', d.date) AS DATE) = w.week)"""

STICK_SQL = f"""{WEEK_SQL},
stick AS (
  SELECT *, CAST(trunc(round_even(CAST(dau AS DOUBLE) / wau_calendar * 100, 0) / 100 * 100) AS INTEGER)
              AS week_stick
  FROM day_week)"""


@query("dau", f"WITH {DAILY_SQL} SELECT * FROM daily")
def dau(spark, folder):
    return activity.daily_active(events(spark, folder))


@query("wau_calendar", f"WITH {WEEK_SQL} SELECT * FROM weekly")
def wau_calendar(spark, folder):
    return activity.weekly_active(events(spark, folder))


@query(
    "mau",
    "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(DISTINCT user_id) AS mau "
    "FROM events GROUP BY 1",
)
def mau(spark, folder):
    return activity.monthly_active(events(spark, folder))


@query("wau_trailing", f"WITH {TRAILING_SQL} SELECT * FROM trailing_week")
def wau_trailing(spark, folder):
    return activity.trailing_stickiness(events(spark, folder)).select("date", "wau_trailing")


@query(
    "dau_wau_stickiness",
    f"""WITH {TRAILING_SQL}
SELECT d.date, d.dau, w.wau_trailing, CAST(d.dau AS DOUBLE) / w.wau_trailing AS stickiness
FROM daily d JOIN trailing_week w ON d.date = w.date ORDER BY d.date""",
)
def dau_wau_stickiness(spark, folder):
    return activity.trailing_stickiness(events(spark, folder)).orderBy("date")


@query(
    "trailing_from_state",
    f"""WITH {TRAILING_SQL}
SELECT d.date, d.dau, w.wau_trailing FROM daily d JOIN trailing_week w ON d.date = w.date
WHERE d.date > (SELECT max(date) FROM daily) - {REPORTED_DAYS}""",
)
def trailing_from_state(spark, folder):
    # The log arrives in three parts, errors two days late; each part meets the state
    # of the one before, and the last state gives the report of all days it covers.
    log = events(spark, folder)
    day = F.to_date("ts")
    arrival = F.date_add(day, F.when(F.col("event_type") == "error", 2).otherwise(0))
    last = log.agg(F.max(day)).first()[0]
    if last is None:
        return daily_state.report(spark.createDataFrame([], daily_state.STATE), dt.date(1970, 1, 1))
    ends = [last - dt.timedelta(days=back) for back in (10, 5, 0)]
    state, was = None, None
    for end in ends:
        part = log if was is None else log.filter(arrival > F.lit(was))
        part = part if end == last else part.filter(arrival <= F.lit(end))
        state = materialise(daily_state.advance(state, was, part, end))
        was = end
    return daily_state.report(state, last, REPORTED_DAYS)


@query(
    "dau_wau_selfjoin",
    """WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events)
SELECT a.date, count(DISTINCT a.user_id) AS dau, count(DISTINCT w.user_id) AS wau_trailing,
       CAST(count(DISTINCT a.user_id) AS DOUBLE) / count(DISTINCT w.user_id) AS stickiness
FROM days a LEFT JOIN days w ON w.date BETWEEN a.date - 6 AND a.date GROUP BY a.date""",
)
def dau_wau_selfjoin(spark, folder):
    # The left self-join pairs every row with its own week; the numbers are
    # those of the disjoint stretches, without the pairs.
    return activity.trailing_stickiness(events(spark, folder))


@query(
    "active_dates",
    "SELECT DISTINCT CAST(ts AS DATE) AS date FROM events",
)
def active_dates(spark, folder):
    return events(spark, folder).select(F.to_date("ts").alias("date")).distinct()


@query(
    "active_date_bounds",
    "SELECT CAST(min(ts) AS DATE) AS min_date, CAST(max(ts) AS DATE) AS max_date FROM events",
)
def active_date_bounds(spark, folder):
    return activity.date_bounds(events(spark, folder))


@query("unique_users", "SELECT count(DISTINCT user_id) AS unique_users FROM events")
def unique_users(spark, folder):
    return activity.unique_users(events(spark, folder))


@query(
    "active_range_series",
    f"""WITH {DAILY_SQL}
SELECT date, avg(dau) AS dau FROM daily
WHERE date BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}' GROUP BY date""",
)
def active_range_series(spark, folder):
    daily = activity.daily_active(events(spark, folder))
    return activity.mean_series(
        cleaning.between_days(daily, "date", RANGE_START, RANGE_END), "date", "dau"
    )


@query(
    "active_open_range_series",
    f"""WITH {DAILY_SQL}
SELECT date, avg(dau) AS dau FROM daily WHERE date >= DATE '{RANGE_START}' GROUP BY date""",
)
def active_open_range_series(spark, folder):
    daily = activity.daily_active(events(spark, folder))
    return activity.mean_series(cleaning.between_days(daily, "date", RANGE_START), "date", "dau")


GAP_SQL = f"""WITH {WEEK_SQL}
SELECT week, CAST(sum(dau) AS BIGINT) AS dau_sum, max(wau_calendar) AS wau_calendar,
       CAST(sum(dau) AS BIGINT) - max(wau_calendar) AS dau_wau_diff
FROM day_week GROUP BY week"""


@query("dau_week_gap", GAP_SQL)
def dau_week_gap(spark, folder):
    return activity.week_gap(events(spark, folder))


@query(
    "week_gap_series",
    f"SELECT week, avg(dau_wau_diff) AS dau_wau_diff FROM ({GAP_SQL}) GROUP BY week",
)
def week_gap_series(spark, folder):
    return activity.mean_series(activity.week_gap(events(spark, folder)), "week", "dau_wau_diff")


@query(
    "day_stickiness",
    f"WITH {STICK_SQL} SELECT week, date, dau, day_name, wau_calendar, week_stick FROM stick",
)
def day_stickiness(spark, folder):
    return activity.day_stickiness(events(spark, folder))


WEEKLY_STICK_SQL = f"""WITH {STICK_SQL}
SELECT week, round_even(avg(week_stick), 0) AS week_stick_mean FROM stick GROUP BY week"""


@query("week_stickiness", WEEKLY_STICK_SQL)
def week_stickiness(spark, folder):
    return activity.week_stickiness(activity.day_stickiness(events(spark, folder)))


@query(
    "release_day_stickiness",
    f"""WITH {STICK_SQL}
SELECT week, round_even(avg(week_stick), 0) AS week_stick_mean FROM stick
WHERE day_name IN ('Sunday', 'Wednesday') GROUP BY week""",
)
def release_day_stickiness(spark, folder):
    return activity.week_stickiness(activity.day_stickiness(events(spark, folder)), RELEASE_DAYS)


@query(
    "mean_stickiness",
    f"""SELECT round_even(avg(week_stick_mean), 0) AS mean_stick,
       round_even(avg(week_stick_mean), 0) / 100 * 7 AS days_per_week
FROM ({WEEKLY_STICK_SQL})""",
)
def mean_stickiness(spark, folder):
    weekly = activity.week_stickiness(activity.day_stickiness(events(spark, folder)))
    return activity.overall_stickiness(weekly)


@query(
    "series_points",
    f"""SELECT 'stickiness' AS id,
       CAST(to_json(list({{'x': strftime(week, '%Y-%m-%d'), 'y': week_stick_mean}} ORDER BY week))
            AS VARCHAR) AS data
FROM ({WEEKLY_STICK_SQL})""",
)
def series_points(spark, folder):
    weekly = activity.week_stickiness(activity.day_stickiness(events(spark, folder)))
    named = weekly.withColumn("week", F.date_format("week", "yyyy-MM-dd"))
    series = content.chart_points(named, "week", "week_stick_mean", "stickiness")
    return series.withColumn("data", F.to_json("data"))


@query(
    "first_activity_month",
    "SELECT user_id, strftime(min(ts), '%Y-%m') AS cohort_month FROM events GROUP BY user_id",
)
def first_activity_month(spark, folder):
    return activity.first_activity_month(events(spark, folder))


@query(
    "hourly_activity",
    "SELECT CAST(extract(hour FROM ts) AS INTEGER) AS hour, count(*) AS cnt FROM events GROUP BY 1",
)
def hourly_activity(spark, folder):
    return dayparts.hourly_activity(events(spark, folder))


DAYPARTS_SQL = """
parts AS (
  SELECT user_id,
         count(*) FILTER (extract(hour FROM ts) BETWEEN 6 AND 11) AS morning,
         count(*) FILTER (extract(hour FROM ts) BETWEEN 12 AND 18) AS day,
         count(*) FILTER (extract(hour FROM ts) NOT BETWEEN 6 AND 18) AS night
  FROM events GROUP BY user_id),
shares AS (
  SELECT *,
         round_even(CAST(morning AS DOUBLE) / (morning + day + night) * 100, 0) AS morning_ratio,
         round_even(CAST(day AS DOUBLE) / (morning + day + night) * 100, 0) AS day_ratio,
         round_even(CAST(night AS DOUBLE) / (morning + day + night) * 100, 0) AS night_ratio
  FROM parts)"""


@query("user_dayparts", f"WITH {DAYPARTS_SQL} SELECT * FROM parts")
def user_dayparts(spark, folder):
    return dayparts.user_dayparts(events(spark, folder))


@query("daypart_share", f"WITH {DAYPARTS_SQL} SELECT * FROM shares")
def daypart_share(spark, folder):
    return dayparts.daypart_shares(dayparts.user_dayparts(events(spark, folder)))
