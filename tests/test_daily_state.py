import datetime as dt
import random

import pytest

from footfall.operators import activity, daily_state

START = dt.date(2024, 1, 1)


def day(number):
    return START + dt.timedelta(days=number)


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, days int")


def made_log(seed=1):
    """(user, instant, day of arrival) over 30 days, some rows up to nine days late."""
    rng = random.Random(seed)
    rows = []
    for _ in range(1500):
        user, at = rng.randrange(60), rng.randrange(30)
        if at % 11 == 5:
            continue
        late = rng.choice([0, 0, 0, 1, 4, 9])
        instant = dt.datetime.combine(day(at), dt.time(rng.randrange(24), 59, 59))
        rows.append((user, instant, min(at + late, 29)))
    return rows


def full(spark, rows):
    log = frame(spark, [(u, t, 0) for u, t, _ in rows])
    return {r["date"]: (r["dau"], r["wau_trailing"]) for r in activity.trailing_stickiness(log).collect()}


def told(report):
    return {r["date"]: (r["dau"], r["wau_trailing"]) for r in report.collect()}


def test_daily_updates_equal_the_full_run_late_days_included(spark):
    rows, state, was = made_log(), None, None
    for end in (0, 1, 2, 9, 10, 11, 12, 20, 28, 29):
        arrived = [r for r in rows if r[2] <= end and (was is None or r[2] > was)]
        log = frame(spark, [(u, t, 0) for u, t, _ in arrived] + [(None, dt.datetime(2024, 1, 1), 0), (3, None, 0)])
        state = daily_state.advance(state, None if was is None else day(was), log, day(end), keep_days=40)
        state = spark.createDataFrame(state.collect(), daily_state.STATE)
        was = end
        so_far = full(spark, [r for r in rows if r[2] <= end])
        got = told(daily_state.report(state, day(end), end + 1))
        assert got == {d: v for d, v in so_far.items() if d <= day(end)}


def test_users_leave_and_rows_outside_the_kept_days_raise(spark):
    first = daily_state.advance(None, None, frame(spark, [(1, dt.datetime(2024, 1, 1), 0), (2, dt.datetime(2024, 1, 5), 0)]), day(4), 10)
    assert sorted(map(tuple, first.collect())) == [(1, 16), (2, 1)]
    empty = frame(spark, [])
    moved = daily_state.advance(first, day(4), empty, day(12), 10)
    assert sorted(map(tuple, moved.collect())) == [(2, 256)]
    assert daily_state.advance(first, day(4), empty, day(400), 10).count() == 0
    for wrong in (dt.datetime(2023, 12, 20), dt.datetime(2024, 1, 6)):
        with pytest.raises(Exception, match="outside the days kept"):
            daily_state.advance(first, day(4), frame(spark, [(1, wrong, 0)]), day(4), 10).collect()
    with pytest.raises(ValueError, match="cannot go back"):
        daily_state.advance(first, day(4), empty, day(3))
    with pytest.raises(ValueError, match="keep_days"):
        daily_state.advance(None, None, empty, day(3), 63)


def test_longest_state_and_nothing(spark):
    log = frame(spark, [(7, dt.datetime.combine(day(k), dt.time(0)), 0) for k in range(62)])
    state = daily_state.advance(None, None, log, day(61), daily_state.MOST_DAYS)
    assert state.first()["days"] == (1 << 62) - 1
    assert daily_state.advance(state, day(61), log.limit(0), day(62), 62).first()["days"] == (1 << 62) - 2
    assert daily_state.report(daily_state.advance(None, None, log.limit(0), day(0)), day(0), 3).count() == 0
