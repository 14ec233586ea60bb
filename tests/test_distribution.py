"""Quantiles, positions, moving averages, histograms, density."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import plan_text
from footfall.operators import histograms, ordering, quantiles

numbers = st.lists(st.floats(-1e6, 1e6).map(lambda v: round(v, 3)), min_size=1, max_size=60)


def frame(spark, values, name="v"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double").repartition(4)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(numbers, st.lists(st.floats(0, 1), min_size=1, max_size=4, unique=True))
def test_exact_quantiles_match_numpy(spark, values, probabilities):
    got = quantiles.quantile_edges(frame(spark, values), ["v"], probabilities)
    for p in probabilities:
        assert math.isclose(got[("v", p)], np.percentile(values, p * 100), rel_tol=1e-9, abs_tol=1e-6)


def test_quantiles_of_many_values_and_a_hot_one(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(5000, 7.0), rng.normal(0, 50, 10_000)])
    df = spark.createDataFrame(pd.DataFrame({"a": values, "b": values[::-1] * 2})).repartition(8)
    got = quantiles.quantile_edges(df, ["a", "b"], [0.0, 0.2, 0.4, 0.6, 0.8, 0.99, 1.0])
    for p in (0.0, 0.2, 0.4, 0.6, 0.8, 0.99, 1.0):
        assert math.isclose(got[("a", p)], np.percentile(values, p * 100), rel_tol=1e-12)
        assert math.isclose(got[("b", p)], 2 * np.percentile(values, p * 100), rel_tol=1e-12)


def test_ordered_bits_sort_like_the_doubles():
    rng = np.random.default_rng(3)
    values = np.concatenate(
        [rng.standard_normal(500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, 5e-324, -5e-324, np.inf, -np.inf]]
    )
    keys = quantiles.ordered_bits(values)
    assert (np.argsort(keys) == np.argsort(values)).all()
    assert (quantiles.from_ordered_bits(keys) == values).all()
    odd = quantiles.ordered_bits(np.array([-0.0, 0.0, np.inf, -np.nan, np.nan]))
    assert odd[0] == odd[1] and odd[3] == odd[4] > odd[2]


def test_quantiles_read_on_inside_ranges_that_hold_many_rows(spark, monkeypatch):
    """With a small bound for few rows, every pass down to the last bit is taken."""
    monkeypatch.setattr(quantiles, "FEW", 2)
    rng = np.random.default_rng(4)
    close = 1.0 + rng.integers(0, 400, 2_000) * 2.0**-50
    wide = rng.standard_normal(2_000) * 10.0 ** rng.integers(-200, 200, 2_000)
    rows = [("close", float(v)) for v in close] + [("wide", float(v)) for v in wide]
    rows += [("one", 7.0), ("same", -3.5), ("same", -3.5), ("none", None), (None, 1.0)]
    long = spark.createDataFrame(rows, "metric string, value double").repartition(5)
    wanted = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["metric"], r["probability"]): r["value"] for r in quantiles.quantiles_by_metric(long, wanted).collect()}
    slow = {(r["metric"], r["probability"]): r["value"] for r in quantiles.quantiles_by_slices(long, wanted).collect()}
    assert got == slow
    assert set(got) == {(m, p) for m in ("close", "wide", "one", "same") for p in wanted}
    for name, values in (("close", close), ("wide", wide)):
        for p in wanted:
            assert got[(name, p)] == pytest.approx(np.quantile(values, p), rel=1e-15)


def test_quantiles_of_more_metrics_than_the_driver_holds(spark):
    rows = [(i % 300, float(i * 7919 % 1_000)) for i in range(3_000)]
    long = spark.createDataFrame(rows, "metric int, value double")
    got = {r["metric"]: r["value"] for r in quantiles.quantiles_by_metric(long, [0.3]).collect()}
    assert got == {
        m: pytest.approx(np.quantile([v for k, v in rows if k == m], 0.3)) for m in range(300)
    }


def test_quantiles_skip_nulls_and_empty_input(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert quantiles.quantile_edges(df, ["v"], [0.5])[("v", 0.5)] == 2.0
    assert math.isnan(quantiles.quantile_edges(df.filter("v > 9"), ["v"], [0.5])[("v", 0.5)])


def test_positions_follow_the_order(spark):
    df = spark.range(5000).selectExpr("id", "hash(id) AS k").repartition(6)
    rows = ordering.with_position(df, ["k", "id"]).collect()
    ordered = sorted(rows, key=lambda r: (r["k"], r["id"]))
    assert [r["position"] for r in ordered] == list(range(5000))


@pytest.mark.parametrize("block", [14, 15, 40, 100_000])
@pytest.mark.parametrize("count", [1, 13, 14, 200])
def test_moving_average(spark, count, block):
    rng = np.random.default_rng(count)
    values = rng.integers(0, 1000, count)
    order = rng.permutation(count)
    df = spark.createDataFrame([(int(i), int(values[i])) for i in order], "k int, v long").repartition(5)
    got = {r["k"]: r["moving_average"] for r in ordering.moving_average(df, "v", ["k"], 14, block=block).collect()}
    expected = pd.Series(values).rolling(14).mean()
    assert len(got) == count
    for k, value in expected.items():
        if math.isnan(value):
            assert got[k] is None
        else:
            assert math.isclose(got[k], value, rel_tol=1e-9)


def test_moving_average_never_windows_the_whole_table(spark):
    df = spark.range(500).selectExpr("id AS k", "id AS v")
    text = plan_text(ordering.moving_average(df, "v", ["k"], 14))
    whole = [line for line in text.splitlines() if "Window" in line and "avg(" in line]
    assert whole and all("[_block" in line for line in whole)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.integers(0, 200), min_size=1, max_size=60), st.sampled_from([8, 20]))
def test_histogram_matches_numpy(spark, values, bins):
    rows = histograms.histograms(frame(spark, values), ["v"], bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=bins)
    assert [r["cnt"] for r in rows] == counts.tolist()
    assert np.allclose([r["lower"] for r in rows] + [rows[-1]["upper"]], edges)


def test_density_curve(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(100, 15, 300)
    rows = histograms.density_curve(frame(spark, values), "v", bins=8, points=50).orderBy("point").collect()
    grid = np.linspace(values.min(), values.max(), 50)
    width = values.std(ddof=1) * len(values) ** -0.2
    kernel = np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).sum(axis=1)
    density = kernel / (len(values) * width * math.sqrt(2 * math.pi))
    assert np.allclose([r["x"] for r in rows], grid)
    assert np.allclose([r["density"] for r in rows], density)
    bin_width = (values.max() - values.min()) / 8
    assert np.allclose([r["scaled"] for r in rows], density * 300 * bin_width)


def test_density_of_constant_column_is_empty(spark):
    assert histograms.density_curve(frame(spark, [4.0, 4.0]), "v").count() == 0


def test_dates_order_too(spark):
    rows = [(dt.date(2024, 1, d % 28 + 1), d) for d in range(60)]
    df = spark.createDataFrame(rows, "day date, n int").repartition(3)
    got = ordering.with_position(df, ["day", "n"]).orderBy("position").collect()
    assert [(r["day"], r["n"]) for r in got] == sorted(rows)


def test_nan_takes_no_part(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "v double")
    assert quantiles.quantile_edges(df, ["v"], [0.5, 1.0]) == {("v", 0.5): 2.0, ("v", 1.0): 3.0}
    bars = histograms.histograms(df, ["v"], 2).collect()
    assert sorted((r["lower"], r["cnt"]) for r in bars) == [(1.0, 1), (2.0, 2)]
    assert histograms.density_curve(df, "v").count() == 200
    assert histograms.density_curve(df.filter("v > 2"), "v").count() == 0
