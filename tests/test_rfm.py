import datetime as dt
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import plan_text
from footfall.operators import cleaning, pricing, rfm
from footfall.plans import bindings

START = dt.date(2024, 1, 1)
purchases = st.lists(
    st.tuples(st.integers(1, 4), st.integers(0, 60), st.integers(1, 50)), min_size=1, max_size=50
)


def make(spark, rows):
    data = [
        (u, dt.datetime.combine(START + dt.timedelta(days=d), dt.time(d % 24)), p) for u, d, p in rows
    ]
    return spark.createDataFrame(data, "user_id long, ts timestamp_ntz, price long")


def summary(rows, end):
    """Plain restatement: day sums per user, first day left out."""
    daily = defaultdict(lambda: defaultdict(int))
    for user, day, price in rows:
        if day <= end:
            daily[user][day] += price
    out = {}
    for user, days in daily.items():
        order = sorted(days)
        rest = [days[d] for d in order[1:]]
        mean = sum(rest) / len(rest) if rest else 0.0
        out[user] = (len(order) - 1, order[-1] - order[0], end - order[0], mean)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(purchases, st.integers(20, 70))
def test_rfm_repeat_brute_force(spark, rows, end):
    got = rfm.rfm_repeat(make(spark, rows), START + dt.timedelta(days=end)).collect()
    found = {r["user_id"]: (r["frequency"], r["recency"], r["T"], r["monetary_value"]) for r in got}
    assert found == summary(rows, end)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(purchases, st.integers(5, 40))
def test_calibration_holdout_brute_force(spark, rows, holdout):
    end = 55
    got = rfm.calibration_holdout(make(spark, rows), START + dt.timedelta(days=end), holdout).collect()
    found = {
        r["user_id"]: (
            (r["frequency_cal"], r["recency_cal"], r["T_cal"], r["monetary_value_cal"]),
            (r["frequency_holdout"], r["monetary_value_holdout"], r["duration_holdout"]),
        )
        for r in got
    }
    expected = {}
    for user, cal in summary(rows, end - holdout).items():
        late = [(d, p) for u, d, p in rows if u == user and end - holdout < d <= end]
        mean = sum(p for _, p in late) / len(late) if late else 0.0
        expected[user] = (cal, (len({d for d, _ in late}), mean, holdout))
    assert found == expected


def test_one_active_day(spark):
    row = rfm.rfm_repeat(make(spark, [(1, 3, 10), (1, 3, 5)]), "2024-01-31").first()
    assert (row["frequency"], row["recency"], row["T"], row["monetary_value"]) == (0, 0, 27, 0.0)


EPISODES = [("e1", dt.date(2024, 3, 1)), ("e2", dt.date(2024, 3, 5))]
COMMENTS = [
    ("e1", 1, dt.datetime(2024, 3, 1, 0, 0), 3),
    ("e1", 2, dt.datetime(2024, 2, 29, 23, 59), 0),
    ("e2", 1, dt.datetime(2024, 3, 4, 1, 0), 7),
    ("e2", 1, dt.datetime(2024, 3, 6, 1, 0), 1),
    ("e9", 1, dt.datetime(2024, 3, 6, 1, 0), 2),
]


@pytest.fixture
def comments(spark):
    return spark.createDataFrame(
        COMMENTS, "episode string, user_id long, comment_date timestamp_ntz, comment_like long"
    )


@pytest.fixture
def episodes(spark):
    return spark.createDataFrame(EPISODES, "episode string, upload_at date")


def test_price_boundaries(comments, episodes):
    rows = pricing.priced_comments(comments, episodes).collect()
    price = {(r["episode"], r["user_id"], r["comment_date"]): (r["cookie"], r["price"]) for r in rows}
    assert price[("e1", 1, dt.datetime(2024, 3, 1))] == (0, 503)
    assert price[("e1", 2, dt.datetime(2024, 2, 29, 23, 59))] == (1200, 1700)
    assert price[("e9", 1, dt.datetime(2024, 3, 6, 1))] == (0, 502)
    assert len(rows) == len(COMMENTS)


def test_rfm_simple_counts_first_comment_only(comments, episodes):
    rows = {r["user_id"]: r for r in rfm.rfm_simple(comments, episodes).collect()}
    assert rows[1]["frequency"] == 2 and rows[1]["monetary"] == 1200 and rows[1]["recency"] == 3
    assert rows[2]["first_comment_date"] == rows[2]["last_comment_date"] == dt.date(2024, 2, 29)


def test_rfm_simple_keeps_repeated_episodes(comments, episodes):
    rows = {r["user_id"]: r for r in rfm.rfm_simple(comments, episodes.union(episodes)).collect()}
    assert rows[1]["frequency"] == 4


def test_first_per_key_cuts_before_the_shuffle(spark, data_root):
    first = cleaning.first_per_key(
        bindings.comments(spark, f"{data_root}/sf0.001"), ["chapter", "user_id"], ["comment_date", "event_id"]
    )
    text = plan_text(first)
    assert text.count("WindowGroupLimit") == 2 and text.index("Exchange") < text.rindex("Partial")


def test_large_dimension_and_hot_episode(spark):
    """Beyond the broadcast limit the join sorts, splits the hot key, and agrees."""
    hot = spark.range(200_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'e1' ELSE concat('e', id % 500) END AS episode",
        "id % 997 AS user_id",
        "timestamp_ntz '2024-03-01 00:00:00' + make_dt_interval(cast(id % 9 as int)) AS comment_date",
        "id % 5 AS comment_like",
    )
    episodes = spark.range(500).selectExpr("concat('e', id) AS episode", "date '2024-03-05' AS upload_at")

    def totals():
        priced = pricing.priced_comments(hot, episodes)
        df = rfm.rfm_repeat(priced, "2024-03-31", ts="comment_date").selectExpr(
            "sum(frequency)", "sum(monetary_value)", "count(*)"
        )
        return [round(v, 6) for v in df.collect()[0]], plan_text(df)

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    small, plan = totals()
    assert "BroadcastHashJoin" in plan
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        large, plan = totals()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert small == large


def test_observation_end_reaches_the_scan(spark, data_root):
    log = bindings.transactions(spark, f"{data_root}/sf0.001")
    text = plan_text(rfm.rfm_repeat(log, rfm.last_day(log)))
    assert "LessThan(o_orderdate" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_last_day_of_empty_log(spark):
    with pytest.raises(ValueError):
        rfm.last_day(spark.createDataFrame([], "ts timestamp_ntz"))


def test_merged_daily_states_equal_one_pass(spark):
    rng = random.Random(4)
    rows = [
        (rng.randrange(25), dt.datetime(2024, 1, 1 + rng.randrange(12), rng.randrange(24)), rng.randrange(1, 900))
        for _ in range(300)
    ]
    log = spark.createDataFrame([*rows, (3, None, 5)], "user_id long, ts timestamp_ntz, price long")
    whole = rfm.rfm_repeat(log.filter("ts IS NOT NULL"), dt.date(2024, 1, 12))
    days = [rfm.repeat_state(log.filter(f"day(ts) % 4 = {k}")) for k in (2, 0, 3, 1)]
    merged = rfm.rfm_of_state(rfm.merge_states(*days), dt.date(2024, 1, 12))
    assert merged.columns == whole.columns
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    step = rfm.merge_states(rfm.merge_states(days[0], days[1]), rfm.merge_states(days[3], days[2]))
    assert sorted(map(tuple, rfm.rfm_of_state(step, dt.date(2024, 1, 12)).collect())) == sorted(map(tuple, whole.collect()))
    with pytest.raises(ValueError, match="lies in two parts"):
        rfm.merge_states(days[0], days[1], days[0])
    assert rfm.merge_states(rfm.repeat_state(log.limit(0))).count() == 0
