import math

import numpy as np
import pandas as pd
import pytest

from footfall.functions import special
from footfall.models import bgnbd, fitting, gammagamma, value
from footfall.models.bgnbd import BetaGeo
from footfall.models.gammagamma import GammaGamma

TRUE = BetaGeo(r=0.9, alpha=12.0, a=0.8, b=2.5)


def simulate(count, seed, horizon=0.0):
    """Customers of a BG/NBD world: summary up to T and purchases in the horizon."""
    rng = np.random.default_rng(seed)
    rate = rng.gamma(TRUE.r, 1 / TRUE.alpha, count)
    stop = rng.beta(TRUE.a, TRUE.b, count)
    end = rng.integers(60, 160, count).astype(float)
    x, last, later = np.zeros(count), np.zeros(count), np.zeros(count)
    clock = np.zeros(count)
    alive = np.ones(count, dtype=bool)
    while alive.any():
        clock = np.where(alive, clock + rng.exponential(1 / rate), clock)
        inside = alive & (clock <= end)
        after = alive & (clock > end) & (clock <= end + horizon)
        x[inside] += 1
        last[inside] = clock[inside]
        later[after] += 1
        alive &= (clock <= end + horizon) & (rng.random(count) >= stop)
    return pd.DataFrame({"frequency": x, "recency": last, "T": end, "later": later})


def numeric_slopes(function, point, step=1e-5):
    """Central differences of a vector function of the parameters."""
    out = []
    for i, p in enumerate(point):
        up, down = point.copy(), point.copy()
        up[i] += step * p
        down[i] -= step * p
        out.append((function(up) - function(down)) / (2 * step * p))
    return np.array(out)


KERNELS = {
    "bgnbd": (
        bgnbd,
        {
            "frequency": np.array([0.0, 1.0, 5.0, 40.0, 1.0]),
            "recency": np.array([0.0, 3.0, 8.0, 9.9, 9.0]),
            "T": np.array([10.0, 9.0, 10.0, 10.0, 9.0]),
        },
        [np.array([0.7, 2.0, 0.6, 1.8]), np.array([9.0, 11.0, 1e-6, 0.01])],
    ),
    "gammagamma": (
        gammagamma,
        {"frequency": np.array([1.0, 4.0, 30.0, 4.0]), "monetary_value": np.array([5.0, 80.0, 31.5, 2.0])},
        [np.array([3.0, 2.2, 20.0]), np.array([0.4, 30.0, 1.0])],
    ),
}


@pytest.mark.parametrize("name", KERNELS)
def test_kernel_sums_slopes_and_curvature(name):
    module, arrays, points = KERNELS[name]
    weights = np.array([1.0, 3.0, 2.0, 5.0, 1.0])[: len(arrays["frequency"])]
    size = len(points[0])
    sums = lambda p: module._sums(arrays, weights, p[None])[0]
    both = module._sums(arrays, weights, np.array(points))
    for point, row in zip(points, both, strict=True):
        assert row[0] == pytest.approx(weights @ module._log_likelihood(arrays, point[None])[:, 0], rel=1e-12)
        slopes = numeric_slopes(lambda p: sums(p)[0], point)
        assert np.allclose(row[1 : size + 1], slopes, rtol=1e-5, atol=1e-6 * abs(row[0]))
        upper = numeric_slopes(lambda p: sums(p)[1 : size + 1], point)[np.triu_indices(size)]
        assert np.allclose(row[size + 1 :], upper, rtol=1e-4, atol=1e-4 * np.abs(row[1 : size + 1]).max())


def test_trigamma():
    assert special.trigamma(1.0) == pytest.approx(np.pi**2 / 6, rel=1e-13)
    assert special.trigamma(0.5) == pytest.approx(np.pi**2 / 2, rel=1e-13)
    z = np.array([1e-6, 0.3, 2.0, 9.9, 10.1, 400.0])
    assert np.allclose(special.trigamma(z), special.trigamma(z + 1) + 1 / z**2, rtol=1e-12)


def test_bgnbd_recovers_parameters(spark):
    df = spark.createDataFrame(simulate(20_000, 1)).repartition(8)
    model = bgnbd.fit_bgnbd(bgnbd.customer_cells(df), [0.0])[0]
    assert model.converged
    assert model.r == pytest.approx(TRUE.r, rel=0.1)
    assert model.alpha == pytest.approx(TRUE.alpha, rel=0.12)
    assert model.a / (model.a + model.b) == pytest.approx(TRUE.a / (TRUE.a + TRUE.b), rel=0.1)


def test_standard_errors_cover_the_truth_and_shrink_with_customers(spark):
    fits = {}
    for count in (4_000, 36_000):
        cells = bgnbd.customer_cells(spark.createDataFrame(simulate(count, 11)))
        fits[count] = bgnbd.fit_bgnbd(cells, [0.0])[0]
        own = fits[count].certainty
        assert own.flat == ()
        for name, error in own.errors.items():
            assert abs(getattr(fits[count], name) - getattr(TRUE, name)) < 4 * error
    few, many = (fits[c].certainty.errors for c in (4_000, 36_000))
    assert all(2.0 < few[n] / many[n] < 4.5 for n in few)


def test_data_without_drop_out_leave_both_of_its_parameters_flat(spark):
    rng = np.random.default_rng(12)
    end = np.full(3000, 100.0)
    x = rng.poisson(rng.gamma(2.0, 0.05, 3000) * end).astype(float)
    last = np.where(x > 0, end * rng.random(3000) ** (1 / np.maximum(x, 1)), 0.0)
    df = spark.createDataFrame(pd.DataFrame({"frequency": x, "recency": last, "T": end}))
    model = bgnbd.fit_bgnbd(bgnbd.customer_cells(df), [1e-4])[0]
    assert model.converged and model.certainty.flat == ("a", "b")
    assert np.isnan(model.certainty.errors["a"]) and model.certainty.errors["r"] > 0
    assert model.a >= fitting.LEAST


def test_expectation_at_a_equal_to_one_is_the_limit():
    args = (30.0, np.array([0.0, 3.0]), np.array([0.0, 20.0]), np.array([50.0, 40.0]))
    at = lambda a: bgnbd.expected_purchases_at(BetaGeo(0.9, 12.0, a, 2.5), *args)
    assert np.allclose(at(1.0), (at(1.001) + at(0.999)) / 2, rtol=1e-5)
    assert np.allclose(at(1.0 + 1e-9), at(1.0), rtol=1e-8)


def test_expectation_matches_simulation(spark):
    sample = simulate(200_000, 2, horizon=30.0)
    predicted = bgnbd.expected_purchases_at(
        TRUE, 30.0, sample.frequency.to_numpy(), sample.recency.to_numpy(), sample["T"].to_numpy()
    )
    error = sample.later.std() / math.sqrt(len(sample))
    assert abs(predicted.mean() - sample.later.mean()) < 4 * error
    busy = sample.frequency >= 5
    error = sample.later[busy].std() / math.sqrt(busy.sum())
    assert abs(predicted[busy].mean() - sample.later[busy].mean()) < 4 * error


def test_expectation_starts_at_zero_and_grows():
    x, t, end = np.array([0.0, 3.0]), np.array([0.0, 20.0]), np.array([50.0, 40.0])
    steps = [bgnbd.expected_purchases_at(TRUE, h, x, t, end) for h in (0.0, 1.0, 30.0, 3000.0)]
    assert np.allclose(steps[0], 0.0)
    assert all((b > a).all() for a, b in zip(steps, steps[1:]))


def test_log_likelihood_of_cells_equals_customers(spark):
    df = spark.createDataFrame(simulate(500, 3)).repartition(4)
    total = bgnbd.likelihood_sums(bgnbd.customer_cells(df), [TRUE])[0]
    own = bgnbd.with_log_likelihood(df, TRUE).agg({"loglik": "sum"}).first()[0]
    assert total == pytest.approx(own, rel=1e-12)


def test_spend_likelihood_of_cells_equals_customers(spark):
    df = spark.createDataFrame(spend_sample(500, 9)).repartition(4)
    model = GammaGamma(p=5.0, q=3.0, v=20.0)
    total = gammagamma.likelihood_sums(gammagamma.repeat_spend(df), [model])[0]
    own = gammagamma.with_log_likelihood(df, model).agg({"loglik": "sum"}).first()[0]
    assert total == pytest.approx(own, rel=1e-12)


def spend_sample(count, seed, p=6.0, q=4.0, v=15.0):
    rng = np.random.default_rng(seed)
    rate = rng.gamma(q, 1 / v, count)
    x = rng.integers(1, 10, count).astype(float)
    return pd.DataFrame({"frequency": x, "monetary_value": rng.gamma(p * x, 1 / (rate * x))})


def test_gammagamma_recovers_parameters(spark):
    df = spark.createDataFrame(spend_sample(20_000, 4)).repartition(8)
    model = gammagamma.fit_gammagamma(gammagamma.repeat_spend(df), [0.0])[0]
    assert model.converged
    assert model.p == pytest.approx(6.0, rel=0.15)
    assert model.q == pytest.approx(4.0, rel=0.1)
    assert model.p * model.v / (model.q - 1) == pytest.approx(30.0, rel=0.03)


def test_expected_value_shrinks_towards_population(spark):
    model = GammaGamma(p=6.0, q=4.0, v=15.0)
    df = spark.createDataFrame([(1.0, 90.0), (1000.0, 90.0)], "frequency double, monetary_value double")
    few, many = (r[0] for r in df.select(gammagamma.expected_average_value(model)).collect())
    assert few == pytest.approx((1 - 6 / 9) * 30.0 + 6 / 9 * 90.0)
    assert many == pytest.approx(90.0, abs=0.1)


def test_lifetime_value_discounts_each_month(spark):
    df = spark.createDataFrame([(3.0, 20.0, 40.0, 50.0)], "frequency double, recency double, T double, monetary_value double")
    spend = GammaGamma(p=6.0, q=4.0, v=15.0)
    row = value.with_lifetime_value(df, TRUE, spend, months=3, monthly_rate=0.02).first()
    args = (np.array([3.0]), np.array([20.0]), np.array([40.0]))
    upto = [bgnbd.expected_purchases_at(TRUE, 30.0 * m, *args)[0] for m in range(4)]
    per_purchase = 3 / 21 * 30 + 18 / 21 * 50
    expected = sum((upto[m] - upto[m - 1]) / 1.02**m for m in (1, 2, 3)) * per_purchase
    assert row["ltv"] == pytest.approx(expected)
    assert row["predicted_purchases"] == pytest.approx(upto[3])


def test_grid_equals_single_fits(spark):
    cells = bgnbd.customer_cells(spark.createDataFrame(simulate(2000, 5)))
    grid = bgnbd.fit_bgnbd(cells, [0.0, 0.01, 0.5])
    for model in grid:
        alone = bgnbd.fit_bgnbd(cells, [model.penalty])[0]
        assert model.objective == pytest.approx(alone.objective, rel=1e-6)
    # A stronger penalty leaves smaller parameters in scaled time.
    assert grid[0].r > grid[2].r


def test_long_grid_continues_from_neighbours_to_the_same_optima(spark):
    cells = bgnbd.customer_cells(spark.createDataFrame(simulate(2000, 5)))
    penalties = [10.0 ** (-4 + 0.2 * i) for i in range(20)][::-1]
    for model in bgnbd.fit_bgnbd(cells, penalties)[::6]:
        alone = bgnbd.fit_bgnbd(cells, [model.penalty])[0]
        assert model.converged
        for name in ("r", "alpha", "a", "b"):
            assert getattr(model, name) == pytest.approx(getattr(alone, name), rel=1e-6)


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0)], "actual double, predicted double")
    assert tuple(value.error_scores(df, "actual", "predicted").first()) == (2.0, math.sqrt(2.0), 1.0)


def holdout_frame(spark):
    rows = [(2, 10, 40, 25.0, 3, 30.0, 30), (4, 30, 45, 40.0, 0, 0.0, 30), (1, 5, 50, 20.0, 1, 10.0, 30)]
    names = (
        "frequency_cal long, recency_cal int, T_cal int, monetary_value_cal double, "
        "frequency_holdout long, monetary_value_holdout double, duration_holdout int"
    )
    return spark.createDataFrame(rows, names)


def test_many_models_scored_at_once(spark):
    holdout = holdout_frame(spark)
    pdf = holdout.toPandas()
    other = BetaGeo(r=2.0, alpha=30.0, a=0.5, b=4.0, penalty=0.5)
    got = {r["l2"]: r for r in value.score_purchases(holdout, [TRUE, other]).collect()}
    for model in (TRUE, other):
        predicted = bgnbd.expected_purchases_at(
            model, 30.0, *(pdf[c].to_numpy(float) for c in ("frequency_cal", "recency_cal", "T_cal"))
        )
        off = pdf.frequency_holdout - predicted
        assert got[model.penalty]["mse"] == pytest.approx((off**2).mean())
        assert got[model.penalty]["rmse"] == pytest.approx(math.sqrt((off**2).mean()))
        assert got[model.penalty]["customers"] == 3


def test_spend_score_uses_the_chosen_part(spark):
    model = GammaGamma(p=6.0, q=4.0, v=15.0)
    holdout = holdout_frame(spark)
    pdf = holdout.toPandas()
    for from_holdout, part in ((True, "holdout"), (False, "cal")):
        px = 6.0 * pdf[f"frequency_{part}"]
        weight = px / (px + 3.0)
        off = pdf.monetary_value_holdout - ((1 - weight) * 30.0 + weight * pdf[f"monetary_value_{part}"])
        row = value.score_spend(holdout, [model], from_holdout).first()
        assert row["mse"] == pytest.approx((off**2).mean())


def grid_holdout(spark):
    sample = simulate(800, 6, horizon=30.0)
    money = spend_sample(len(sample), 7)
    holdout = pd.DataFrame(
        {
            "frequency_cal": sample.frequency.astype(int), "recency_cal": sample.recency, "T_cal": sample["T"],
            "monetary_value_cal": money.monetary_value, "frequency_holdout": sample.later.astype(int),
            "monetary_value_holdout": np.where(sample.later > 0, money.monetary_value, 0.0),
            "duration_holdout": 30,
        }
    )
    return spark.createDataFrame(holdout)


RANKINGS = ("bgnbd", "gammagamma_holdout", "gammagamma_forecast")


def test_penalty_grid_marks_one_best_per_model(spark):
    rows = value.penalty_grid(grid_holdout(spark), [0.001, 0.1]).collect()
    assert len(rows) == 6
    assert all(r["at_edge"] for r in rows)
    for model in RANKINGS:
        own = [r for r in rows if r["model"] == model]
        assert [r["l2"] for r in own if r["best"]] == [min(own, key=lambda r: r["mse"])["l2"]]


def test_penalty_search_refines_inside_the_bracket(spark):
    holdout, penalties = grid_holdout(spark), [1e-5, 1e-3, 1e-1, 10.0]
    coarse = {r["model"]: r for r in value.penalty_grid(holdout, penalties).filter("best").collect()}
    found = {r["model"]: r for r in value.penalty_search(holdout, penalties, between=4).collect()}
    assert set(found) == set(RANKINGS)
    for model, row in found.items():
        at = penalties.index(coarse[model]["l2"])
        assert row["grid_l2"] == penalties[at] and row["mse"] <= coarse[model]["mse"]
        assert penalties[max(at - 1, 0)] <= row["l2"] <= penalties[min(at + 1, 3)]
        assert row["at_edge"] == (row["l2"] in (1e-5, 10.0))


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "frequency double, recency double, T double")
    with pytest.raises(ValueError):
        bgnbd.fit_bgnbd(bgnbd.customer_cells(empty), [0.1])


def test_spend_must_be_positive(spark):
    df = spark.createDataFrame([(2.0, 5.0), (3.0, 0.0), (1.0, -2.0), (0.0, 0.0)], "frequency double, monetary_value double")
    with pytest.raises(ValueError, match="2 repeat customers"):
        gammagamma.fit_gammagamma(gammagamma.repeat_spend(df), [0.1])
    assert gammagamma.fit_gammagamma(gammagamma.repeat_spend(df), [0.1], leave_out_unpaid=True)


def test_spend_fit_does_not_depend_on_the_currency(spark):
    sample = spend_sample(3000, 8)
    fits = []
    for unit in (1.0, 1000.0):
        df = spark.createDataFrame(sample.assign(monetary_value=sample.monetary_value * unit))
        fits.append(gammagamma.fit_gammagamma(gammagamma.repeat_spend(df), [0.01])[0])
    assert fits[0].bounded and fits[1].q == pytest.approx(fits[0].q, rel=1e-3)
    assert fits[1].v == pytest.approx(1000.0 * fits[0].v, rel=1e-3)


def test_an_unfinished_search_is_not_used(spark):
    from footfall.models import fitting

    with pytest.raises(RuntimeError, match="0.5"):
        fitting.settled_only([BetaGeo(1, 1, 1, 1, 0.5, 0.0, converged=False)])
    holdout = holdout_frame(spark)
    rows = value.score_purchases(holdout, [BetaGeo(1.0, 9.0, 0.5, 2.0, 0.5, 0.0, False)]).collect()
    assert [r["usable"] for r in rows] == [False]
