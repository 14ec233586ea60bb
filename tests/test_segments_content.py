import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.operators import content, group_tests, segments


def test_segment_edges_belong_below(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 40.0, 40.1, 60.0, 80.0, 80.1)], "v double")
    got = df.select("v", segments.segment_label(F.col("v"), (40.0, 60.0, 80.0)).alias("s")).collect()
    assert {r["v"]: r["s"] for r in got} == {
        1.0: "silver", 40.0: "silver", 40.1: "gold", 60.0: "gold", 80.0: "platinum", 80.1: "diamond",
    }


def test_segments_on_quantiles(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "user_id long, ltv double")
    counts = dict(map(tuple, segments.with_segment(df).groupBy("segment").count().collect()))
    assert counts == {"silver": 40, "gold": 20, "platinum": 20, "diamond": 20}


def customers(spark, count=200):
    rng = np.random.default_rng(1)
    rows = [
        (i, int(rng.integers(0, 90)), int(rng.integers(1, 9)), float(rng.gamma(2, 900)), float(rng.gamma(2, 5e4)))
        for i in range(count)
    ]
    return spark.createDataFrame(
        rows, "user_id long, recency int, frequency long, monetary_value double, ltv double"
    )


@pytest.mark.parametrize("band", [(1, 100), (20, 60)])
def test_percentile_bands(spark, band):
    df = customers(spark)
    pdf = df.toPandas()
    metrics = ["recency", "frequency", "monetary_value", "ltv"]
    keep = np.ones(len(pdf), dtype=bool)
    for m in metrics:
        top, bottom = np.percentile(pdf[m], [100 - band[0], 100 - band[1]])
        keep &= pdf[m].between(bottom, top)
    got = segments.in_bands(df, dict.fromkeys(metrics, band))
    assert sorted(r["user_id"] for r in got.collect()) == sorted(pdf.user_id[keep])


def test_top_share_thresholds(spark):
    df = customers(spark)
    pdf = df.toPandas()
    for row in segments.top_share_thresholds(df, ["recency", "ltv"]).collect():
        expected = np.percentile(pdf[row["metric"]], 80)
        assert math.isclose(row["value"], expected) and row["value_int"] == int(expected)


def test_time_counts_and_cost(spark):
    rows = [("gold", 30.0, 20.0), ("gold", 30.0, 19.0), ("silver", 0.0, 90.0)]
    df = spark.createDataFrame(rows, "segment string, morning_ratio double, day_ratio double")
    counts = segments.segment_time_counts(df)
    assert {(r["segment"], r["time"]): r["segment_cnt"] for r in counts.collect()} == {
        ("gold", "morning/day"): 1, ("gold", "other"): 1, ("silver", "morning/day"): 1,
    }
    assert tuple(segments.promotion_cost(counts).first()) == (3000, 2000)
    assert tuple(segments.promotion_cost(counts.filter("time = 'other'")).first()) == (1000, 0)
    assert tuple(segments.promotion_cost(counts.filter("segment = 'x'")).first()) == (0, 0)


EPISODES = [
    (1, "1화 : 하나(1)", dt.date(2024, 3, 1)),
    (2, "2화 : 하나(2)", dt.date(2024, 3, 3)),
    (3, "3화 : 셋", dt.date(2024, 3, 5)),
    (4, "4화 : 넷", dt.date(2024, 2, 1)),
]


@pytest.fixture
def values(spark):
    comments = [("1화 : 하나(1)", d) for d in (27, 28)] + [("2화 : 하나(2)", 28), ("3화 : 셋", 28)] * 3
    comments += [("4화 : 넷", 28), ("없는 화", 28)]
    log = spark.createDataFrame(
        [(e, dt.datetime(2024, 2, d, 9)) for e, d in comments], "episode string, comment_date timestamp_ntz"
    )
    episodes = spark.createDataFrame(EPISODES, "chapter long, episode string, upload_at date")
    return content.episode_value(log, episodes)


def test_episode_value(values):
    got = {r["chapter"]: r["total_cookie"] for r in values.collect()}
    assert got == {1: 2400, 2: 3600, 3: 3600, 4: 0}
    assert content.mean_value(values).first()["mean_cookie"] == 2400.0


def test_value_trend_is_in_upload_order(values):
    trend = {r["chapter"]: r["moving_average"] for r in content.value_trend(values, rows=2).collect()}
    assert trend == {4: None, 1: 1200.0, 2: 3000.0, 3: 3600.0}


def test_top_episodes_join_first(spark, values):
    snapshot = spark.createDataFrame(
        [("1화 : 하나(1)", 5), ("3화 : 셋", 6), ("4화 : 넷", 7)], "episode string, like_count int"
    )
    rows = content.top_episodes(values, snapshot, 2, "https://example.org/?no=%d").collect()
    assert [(r["chapter"], r["like_count"], r["link"]) for r in rows] == [
        (3, 6, "https://example.org/?no=3"), (1, 5, "https://example.org/?no=1"),
    ]


def test_series_summary(values):
    got = {r["title"]: (r["cookie_mean"], r["series_cnt"]) for r in content.series_summary(values).collect()}
    assert got == {"하나": (3000.0, 2), "셋": (3600.0, 1)}


def samples(spark, groups):
    rows = [(name, float(v)) for name, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "grp string, value double").repartition(3)


def test_welch(spark):
    a = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9, 16.9, 20.1, 21.9, 22.6, 23.1, 19.6, 19.0, 21.7, 21.4]
    b = [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8, 22.0, 24.8, 20.2, 21.9, 22.1, 22.9, 30.5, 25.7]
    row = group_tests.welch_test(samples(spark, {"series": a, "single": b})).first()
    n, va, vb = len(a), np.var(a, ddof=1), np.var(b, ddof=1)
    assert row["t_statistic"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va / n + vb / n))
    assert row["df"] == pytest.approx((va / n + vb / n) ** 2 / ((va / n) ** 2 / (n - 1) + (vb / n) ** 2 / (n - 1)))
    # Student density integrated outside +-t.
    df, t = row["df"], abs(row["t_statistic"])
    u = np.linspace(0, t, 200_001)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    density = density * (1 + u * u / df) ** (-(df + 1) / 2)
    assert row["p_value"] == pytest.approx(1 - 2 * np.trapezoid(density, u), rel=1e-6)


def test_welch_needs_two_values_each(spark):
    row = group_tests.welch_test(samples(spark, {"series": [1.0, 2.0], "single": [3.0]})).first()
    assert row["t_statistic"] is None and row["p_value"] is None


def test_levene(spark):
    a, b = [1.0, 4.0, 2.0, 8.0, 5.0], [10.0, 30.0, 11.0, 60.0]
    row = group_tests.levene_test(samples(spark, {"series": a, "single": b})).first()
    za, zb = np.abs(a - np.median(a)), np.abs(b - np.median(b))
    every = np.concatenate([za, zb])
    between = sum(len(z) * (z.mean() - every.mean()) ** 2 for z in (za, zb))
    within = sum(((z - z.mean()) ** 2).sum() for z in (za, zb))
    assert row["f_statistic"] == pytest.approx((len(every) - 2) * between / within)
    assert (row["groups"], row["df1"], row["df2"]) == (2, 1, 7)
    assert 0 < row["p_value"] < 1


def test_split_by_parts(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 2.0), (0, 9.0)], "series_cnt int, cookie_mean double")
    assert sorted(map(tuple, group_tests.split_by_parts(df).collect())) == [("series", 1.0), ("single", 2.0)]
