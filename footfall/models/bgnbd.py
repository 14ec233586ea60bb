"""BG/NBD model of repeat purchases (Fader, Hardie and Lee, 2005)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.special import digamma, hyp2f1, ln_gamma, trigamma
from footfall.models.fitting import Identified, fit_penalised, identified, spread_out, sum_over

# Times are scaled so that the longest observation is this long; the penalty
# acts on parameters in scaled time.
SCALED_LENGTH = 10.0

# Points the search may begin at, in scaled time.
_STARTS = ((1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 0.1, 1.0), (5.0, 5.0, 0.01, 0.1), (5.0, 5.0, 1e-8, 1e-3))

_NEAR_ONE = 1e-4


@dataclass(frozen=True)
class BetaGeo:
    r: float
    alpha: float
    a: float
    b: float
    penalty: float = 0.0
    objective: float = float("nan")
    converged: bool = True
    certainty: Identified | None = None


def _log_likelihood(arrays: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    """Rows x vectors of log-likelihood."""
    x, t, end = arrays["frequency"], arrays["recency"], arrays["T"]
    r, alpha, a, b = (points[:, i][None, :] for i in range(4))
    # Purchase counts repeat a lot, so Gamma terms are taken per distinct count.
    counts, place = np.unique(x, return_inverse=True)
    c = counts[:, None]
    by_count = (
        ln_gamma(r + c) - ln_gamma(r) + r * np.log(alpha)
        + ln_gamma(a + b) + ln_gamma(b + c) - ln_gamma(b) - ln_gamma(a + b + c)
    )
    return by_count[place] + _alive_or_lapsed(x[:, None], t[:, None], end[:, None], r, alpha, a, b)[0]


def _alive_or_lapsed(x, t, end, r, alpha, a, b):
    """ln(alive + lapsed) and the share of the lapsed term, without overflow."""
    alive = -(r + x) * np.log(alpha + end)
    last = b + np.maximum(x, 1.0) - 1.0
    lapsed = np.where(x > 0, np.log(a) - np.log(last) - (r + x) * np.log(alpha + t), -np.inf)
    top = np.maximum(alive, lapsed)
    e_alive, e_lapsed = np.exp(alive - top), np.exp(lapsed - top)
    return top + np.log(e_alive + e_lapsed), e_lapsed / (e_alive + e_lapsed)


def _sums(arrays: dict[str, np.ndarray], weights: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Weighted log-likelihood, slope and curvature, one row per vector.

    The curvature is that of ln(alive + lapsed): the mean of both curvatures plus
    the spread of both slopes. Each entry is summed as soon as it is formed, so no
    array is larger than rows x vectors.
    """
    x, t, end = arrays["frequency"], arrays["recency"], arrays["T"]
    r, alpha, a, b = (points[:, i] for i in range(4))
    counts, place = np.unique(x, return_inverse=True)
    held, c = np.bincount(place, weights, len(counts)), counts[:, None]
    total = weights.sum()
    own_b, with_a = digamma(b + c) - digamma(b), digamma(a + b) - digamma(a + b + c)
    curve_b, curve_a = trigamma(b + c) - trigamma(b), trigamma(a + b) - trigamma(a + b + c)
    value = held @ (
        ln_gamma(r + c) - ln_gamma(r) + ln_gamma(a + b) + ln_gamma(b + c) - ln_gamma(b) - ln_gamma(a + b + c)
    ) + total * r * np.log(alpha)
    slope = [
        held @ (digamma(r + c) - digamma(r)) + total * np.log(alpha),
        total * r / alpha,
        held @ with_a,
        held @ (with_a + own_b),
    ]
    x, t, end = x[:, None], t[:, None], end[:, None]
    both, lapsed = _alive_or_lapsed(x, t, end, r, alpha, a, b)
    alive, power = 1.0 - lapsed, r + x
    near, far = 1.0 / (alpha + t), 1.0 / (alpha + end)
    ln_near, ln_far = np.log(alpha + t), np.log(alpha + end)
    last = 1.0 / (b + np.maximum(x, 1.0) - 1.0)
    # Slope of the alive term less that of the lapsed one, by parameter.
    apart = [ln_near - ln_far, power * (near - far), np.broadcast_to(-1.0 / a, both.shape), last]
    spread = alive * lapsed
    mean_far, mean_near = weights @ (alive * far), weights @ (lapsed * near)
    value = value + weights @ both
    slope[0] = slope[0] - weights @ (alive * ln_far + lapsed * ln_near)
    slope[1] = slope[1] - weights @ (power * (alive * far + lapsed * near))
    slope[2] = slope[2] + weights @ lapsed / a
    slope[3] = slope[3] - weights @ (lapsed * last)
    curve = {
        (0, 0): held @ (trigamma(r + c) - trigamma(r)),
        (0, 1): total / alpha - mean_far - mean_near,
        (1, 1): weights @ (power * (alive * far**2 + lapsed * near**2)) - total * r / alpha**2,
        (2, 2): held @ curve_a - weights @ lapsed / a**2,
        (2, 3): held @ curve_a,
        (3, 3): held @ (curve_a + curve_b) + weights @ (lapsed * last**2),
    }
    columns = [value, *slope]
    for i in range(4):
        for j in range(i, 4):
            columns.append(curve.get((i, j), 0.0) + weights @ (spread * apart[i] * apart[j]))
    return np.stack(columns, axis=1)


def customer_cells(
    customers: DataFrame, frequency: str = "frequency", recency: str = "recency", age: str = "T"
) -> DataFrame:
    """Distinct (frequency, recency, T) with how many customers share each.

    The likelihood needs nothing else, and whole-day values repeat.
    """
    return customers.groupBy(
        F.col(frequency).cast("double").alias("frequency"),
        F.col(recency).cast("double").alias("recency"),
        F.col(age).cast("double").alias("T"),
    ).agg(F.count(F.lit(1)).alias("n"))


_COLUMNS = ("frequency", "recency", "T")


def likelihood_sums(cells: DataFrame, models: Sequence[BetaGeo]) -> list[float]:
    """Log-likelihood of each model over all customers, in one pass, time as given."""
    points = np.array([[m.r, m.alpha, m.a, m.b] for m in models])
    return [float(v) for v in sum_over(cells, _sums, _COLUMNS, "n", points)[:, 0]]


def with_log_likelihood(customers: DataFrame, model: BetaGeo, name: str = "loglik") -> DataFrame:
    """Each customer's own log-likelihood at given parameters."""
    point = np.array([[model.r, model.alpha, model.a, model.b]])

    @F.pandas_udf("double")
    def own(x: pd.Series, t: pd.Series, end: pd.Series) -> pd.Series:
        arrays = {
            "frequency": x.to_numpy(float), "recency": t.to_numpy(float), "T": end.to_numpy(float),
        }
        return pd.Series(_log_likelihood(arrays, point)[:, 0])

    return customers.withColumn(name, own("frequency", "recency", "T"))


def fit_bgnbd(cells: DataFrame, penalties: Sequence[float]) -> list[BetaGeo]:
    """One model per penalty. Cells are read once per pass, so they are kept."""
    kept = spread_out(cells).persist()
    try:
        longest = kept.agg(F.max("T")).first()[0]
        if not longest or longest <= 0:
            raise ValueError("no observation time to fit on")
        scale = SCALED_LENGTH / longest
        scaled = kept.select(
            "frequency",
            (F.col("recency") * scale).alias("recency"),
            (F.col("T") * scale).alias("T"),
            "n",
        )
        fits = fit_penalised(scaled, _sums, _COLUMNS, "n", _STARTS, penalties)
    finally:
        kept.unpersist()
    return [
        BetaGeo(
            fit.params[0], fit.params[1] / scale, fit.params[2], fit.params[3],
            fit.penalty, fit.objective, fit.converged, _certainty(fit, scale),
        )
        for fit in fits
    ]


def _certainty(fit, scale: float) -> Identified:
    own = identified(fit, ("r", "alpha", "a", "b"))
    return Identified({**own.errors, "alpha": own.errors["alpha"] / scale}, own.flat)


def expected_purchases_at(model: BetaGeo, horizon, x, t, end):
    """Expected purchases in the next `horizon` time units, elementwise.

    At a = 1 the formula is 0 / 0; close to it, values are taken between both sides.
    """
    if abs(model.a - 1.0) < _NEAR_ONE / 2.0:
        part = (model.a - 1.0 + _NEAR_ONE) / (2.0 * _NEAR_ONE)
        low, high = (
            expected_purchases_at(replace(model, a=1.0 + side * _NEAR_ONE), horizon, x, t, end)
            for side in (-1.0, 1.0)
        )
        return low * (1.0 - part) + high * part
    r, alpha, a, b = model.r, model.alpha, model.a, model.b
    z = horizon / (alpha + end + horizon)
    series = hyp2f1(r + x, b + x, a + b + x - 1.0, z)
    bought = (a + b + x - 1.0) / (a - 1.0) * (
        1.0 - series * ((alpha + end) / (alpha + end + horizon)) ** (r + x)
    )
    odds = np.where(
        x > 0, a / (b + np.maximum(x, 1.0) - 1.0) * ((alpha + end) / (alpha + t)) ** (r + x), 0.0
    )
    return bought / (1.0 + odds)


def expected_purchases(
    model: BetaGeo, horizon, frequency: str = "frequency", recency: str = "recency", age: str = "T"
) -> Column:
    """Column of expected purchases; the horizon is a number or a column name."""

    @F.pandas_udf("double")
    def predict(h: pd.Series, x: pd.Series, t: pd.Series, end: pd.Series) -> pd.Series:
        args = (v.to_numpy(float) for v in (h, x, t, end))
        return pd.Series(expected_purchases_at(model, *args))

    h = F.col(horizon) if isinstance(horizon, str) else F.lit(float(horizon))
    return predict(h, frequency, recency, age)
