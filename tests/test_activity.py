import datetime as dt
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import plan_text
from footfall.operators import activity, cleaning, content, dayparts
from footfall.sources.tables import read_table

START = dt.date(2024, 2, 20)
log_rows = st.lists(
    st.tuples(st.integers(1, 6), st.integers(0, 40), st.integers(0, 23)), min_size=1, max_size=80
)


def make_log(spark, rows):
    data = [
        (user, dt.datetime.combine(START + dt.timedelta(days=day), dt.time(hour)))
        for user, day, hour in rows
    ]
    return spark.createDataFrame(data, "user_id long, ts timestamp_ntz")


def users_by_day(rows):
    days = defaultdict(set)
    for user, day, _ in rows:
        days[START + dt.timedelta(days=day)].add(user)
    return days


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(log_rows, st.integers(1, 9))
def test_trailing_stickiness_brute_force(spark, rows, window):
    days = users_by_day(rows)
    got = {
        r["date"]: (r["dau"], r["wau_trailing"], r["stickiness"])
        for r in activity.trailing_stickiness(make_log(spark, rows), window_days=window).collect()
    }
    expected = {}
    for day, users in days.items():
        week = set().union(*(days.get(day - dt.timedelta(days=k), set()) for k in range(window)))
        expected[day] = (len(users), len(week), len(users) / len(week))
    assert got == expected


def test_trailing_equals_range_join(spark, data_root):
    log = read_table(spark, "events", f"{data_root}/sf0.001")
    days = activity.user_days(log)
    a, w = days.alias("a"), days.alias("w")
    joined = (
        a.join(w, F.col("w.date").between(F.date_sub("a.date", 6), F.col("a.date")), "left")
        .groupBy("a.date")
        .agg(F.countDistinct("a.user_id").alias("dau"), F.countDistinct("w.user_id").alias("wau"))
    )
    fast = activity.trailing_stickiness(log).select("date", "dau", "wau_trailing")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, fast.collect()))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(log_rows)
def test_calendar_counts(spark, rows):
    log = make_log(spark, rows)
    days = users_by_day(rows)
    weeks, months = defaultdict(set), defaultdict(set)
    for day, users in days.items():
        weeks[day - dt.timedelta(days=day.weekday())] |= users
        months[day.replace(day=1)] |= users
    assert {r["date"]: r["dau"] for r in activity.daily_active(log).collect()} == {
        d: len(u) for d, u in days.items()
    }
    assert {r["week"]: r["wau_calendar"] for r in activity.weekly_active(log).collect()} == {
        d: len(u) for d, u in weeks.items()
    }
    assert {r["month"]: r["mau"] for r in activity.monthly_active(log).collect()} == {
        d: len(u) for d, u in months.items()
    }
    gap = {r["week"]: r for r in activity.week_gap(log).collect()}
    for week, users in weeks.items():
        total = sum(len(u) for d, u in days.items() if d - dt.timedelta(days=d.weekday()) == week)
        assert gap[week]["dau_sum"] == total >= len(users)
        assert gap[week]["dau_wau_diff"] == total - len(users)


def test_null_users_and_times_are_left_out(spark):
    log = spark.createDataFrame(
        [(1, dt.datetime(2024, 3, 3, 1)), (None, dt.datetime(2024, 3, 3, 2)), (2, None)],
        "user_id long, ts timestamp_ntz",
    )
    assert [tuple(r) for r in activity.daily_active(log).collect()] == [(dt.date(2024, 3, 3), 1, "Sunday")]


def test_week_stickiness_keeps_the_three_roundings(spark):
    stick = spark.createDataFrame(
        [("w1", "Sunday", 28), ("w1", "Monday", 31), ("w2", "Sunday", 56), ("w2", "Monday", 10)],
        "week string, day_name string, week_stick int",
    )
    weekly = activity.week_stickiness(stick)
    assert dict(map(tuple, weekly.collect())) == {"w1": 30.0, "w2": 33.0}
    overall = activity.overall_stickiness(weekly).first()
    assert overall["mean_stick"] == 32.0
    assert overall["days_per_week"] == pytest.approx(2.24)
    only = activity.week_stickiness(stick, ["Sunday"])
    assert dict(map(tuple, only.collect())) == {"w1": 28.0, "w2": 56.0}


def test_open_and_closed_ranges(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 11)], "date date")
    assert cleaning.between_days(df, "date", "2024-01-04", "2024-01-06").count() == 3
    assert cleaning.between_days(df, "date", "2024-01-04").count() == 7


def test_dayparts_cover_every_hour_once(spark):
    log = make_log(spark, [(h, 0, h) for h in range(24)])
    parts = {r["user_id"]: (r["morning"], r["day"], r["night"]) for r in dayparts.user_dayparts(log).collect()}
    assert all(sum(p) == 1 for p in parts.values())
    named = {h: ("morning", "day", "night")[p.index(1)] for h, p in parts.items()}
    assert [named[h] for h in (5, 6, 11, 12, 18, 19)] == ["night", "morning", "morning", "day", "day", "night"]


def test_daypart_share_rounds_half_even(spark):
    parts = spark.createDataFrame([(1, 1, 7, 0), (2, 3, 5, 0)], "user_id long, morning long, day long, night long")
    got = {r["user_id"]: r["morning_ratio"] for r in dayparts.daypart_shares(parts).collect()}
    assert got == {1: 12.0, 2: 38.0}


def test_first_activity_month(spark):
    log = make_log(spark, [(1, 0, 1), (1, 30, 1), (2, 15, 3)])
    assert dict(map(tuple, activity.first_activity_month(log).collect())) == {1: "2024-02", 2: "2024-03"}


def test_chart_points_are_ordered(spark):
    table = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "x string, y double")
    row = content.chart_points(table, "x", "y", "line").first()
    assert row["id"] == "line" and [(p["x"], p["y"]) for p in row["data"]] == [("a", 1.0), ("b", 2.0)]


def test_trailing_plan_has_no_range_join(spark, data_root):
    log = read_table(spark, "events", f"{data_root}/sf0.001")
    text = plan_text(activity.trailing_stickiness(log))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Join" not in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text


def test_week_tables_read_the_log_once(spark, data_root):
    days = activity.days_with_week(read_table(spark, "events", f"{data_root}/sf0.001"))
    text = plan_text(days)
    assert text.count("FileScan") == 1 and "Join" not in text
