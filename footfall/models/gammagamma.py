"""Gamma-Gamma model of spend per purchase (Fader and Hardie, 2013)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.special import digamma, ln_gamma, trigamma
from footfall.models.fitting import Identified, fit_penalised, identified, spread_out, sum_over


@dataclass(frozen=True)
class GammaGamma:
    p: float
    q: float
    v: float
    penalty: float = 0.0
    objective: float = float("nan")
    converged: bool = True
    certainty: Identified | None = None

    @property
    def bounded(self) -> bool:
        """Whether the population mean, v p / (q - 1), exists."""
        return self.q > 1.0


def _log_likelihood(arrays: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    """Rows x vectors of log-likelihood."""
    x, m = arrays["frequency"], arrays["monetary_value"]
    p, q, v = (points[:, i][None, :] for i in range(3))
    counts, place = np.unique(x, return_inverse=True)
    px = p * counts[:, None]
    by_count = ln_gamma(px + q) - ln_gamma(px) - ln_gamma(q) + q * np.log(v)
    x, m = x[:, None], m[:, None]
    return by_count[place] + (p * x - 1.0) * np.log(m) + p * x * np.log(x) - (p * x + q) * np.log(x * m + v)


def _sums(arrays: dict[str, np.ndarray], weights: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Weighted log-likelihood, slope and curvature, one row per vector.

    Gamma terms are taken per distinct count. Each customer enters through ln and
    powers of (spend + v) only, which are summed plain and times the count.
    """
    x, m = arrays["frequency"], arrays["monetary_value"]
    p, q, v = (points[:, i] for i in range(3))
    counts, place = np.unique(x, return_inverse=True)
    held, c = np.bincount(place, weights, len(counts)), counts[:, None]
    total, by_x = weights.sum(), weights * x
    ln_spend = by_x @ (np.log(m) + np.log(x))
    both, own, one = digamma(p * c + q), digamma(p * c), digamma(q)
    both2, own2, one2 = trigamma(p * c + q), trigamma(p * c), trigamma(q)
    sides = np.stack([weights, by_x])
    spend = (x * m)[:, None] + v
    plain, counted = sides @ np.log(spend)
    plain1, counted1 = sides @ (1.0 / spend)
    plain2, counted2 = sides @ (1.0 / spend**2)
    return np.stack(
        [
            held @ (ln_gamma(p * c + q) - ln_gamma(p * c)) - total * (ln_gamma(q) - q * np.log(v))
            + p * ln_spend - weights @ np.log(m) - p * counted - q * plain,
            held @ (c * (both - own)) + ln_spend - counted,
            held @ both - total * (one - np.log(v)) - plain,
            total * q / v - p * counted1 - q * plain1,
            held @ (c**2 * (both2 - own2)),
            held @ (c * both2),
            -counted1,
            held @ both2 - total * one2,
            total / v - plain1,
            p * counted2 + q * plain2 - total * q / v**2,
        ],
        axis=1,
    )


_COLUMNS = ("frequency", "monetary_value")


def likelihood_sums(spend: DataFrame, models: Sequence[GammaGamma]) -> list[float]:
    """Log-likelihood of each model over all customers, in one pass."""
    points = np.array([[m.p, m.q, m.v] for m in models])
    return [float(v) for v in sum_over(spend, _sums, _COLUMNS, "n", points)[:, 0]]


def with_log_likelihood(customers: DataFrame, model: GammaGamma, name: str = "loglik") -> DataFrame:
    """Each customer's own log-likelihood at given parameters."""
    point = np.array([[model.p, model.q, model.v]])

    @F.pandas_udf("double")
    def own(x: pd.Series, m: pd.Series) -> pd.Series:
        arrays = {"frequency": x.to_numpy(float), "monetary_value": m.to_numpy(float)}
        return pd.Series(_log_likelihood(arrays, point)[:, 0])

    return customers.withColumn(name, own("frequency", "monetary_value"))


def repeat_spend(
    customers: DataFrame, frequency: str = "frequency", value: str = "monetary_value"
) -> DataFrame:
    """(frequency, mean value) of repeat customers, one row each.

    Mean values hardly repeat, so customers are summed over one by one.
    """
    return customers.filter(F.col(frequency) > 0).select(
        F.col(frequency).cast("double").alias("frequency"),
        F.col(value).cast("double").alias("monetary_value"),
        F.lit(1).alias("n"),
    )


def fit_gammagamma(
    spend: DataFrame, penalties: Sequence[float], leave_out_unpaid: bool = False
) -> list[GammaGamma]:
    """One model per penalty.

    The model is defined for positive amounts only: others raise, with their
    number, unless `leave_out_unpaid` says to fit without them. Amounts are
    divided by their mean before the fit, so a penalty means the same whatever
    the currency, and `v` is given back in the unit of the amounts. A fit with
    q <= 1 has no population mean; `bounded` tells.
    """
    kept = spread_out(spend).persist()
    try:
        value, n = F.col("monetary_value"), F.col("n")
        paid = F.coalesce((value > 0) & ~F.isnan(value) & (value < float("inf")), F.lit(False))
        row = kept.agg(
            F.coalesce(F.sum(F.when(~paid, n)), F.lit(0)).alias("unpaid"),
            F.try_divide(F.sum(F.when(paid, value * n)), F.sum(F.when(paid, n))).alias("mean"),
        ).first()
        if row["unpaid"] and not leave_out_unpaid:
            raise ValueError(f"{row['unpaid']} repeat customers have no positive finite mean value")
        if row["mean"] is None:
            raise ValueError("no customers to fit")
        scaled = kept.filter(paid).withColumn("monetary_value", value / F.lit(row["mean"]))
        # A strong penalty pulls all three down; a weak one leaves the
        # population mean, v p / (q - 1), near the data mean of one.
        starts = ((1.0, 2.0, 1.0), (5.0, 2.0, 0.5), (2.0, 3.0, 1.0), (1.0, 1.2, 0.3))
        fits = fit_penalised(scaled, _sums, _COLUMNS, "n", starts, penalties)
    finally:
        kept.unpersist()
    return [
        GammaGamma(
            fit.params[0], fit.params[1], fit.params[2] * row["mean"], fit.penalty, fit.objective,
            fit.converged, _certainty(fit, row["mean"]),
        )
        for fit in fits
    ]


def _certainty(fit, unit: float) -> Identified:
    own = identified(fit, ("p", "q", "v"))
    return Identified({**own.errors, "v": own.errors["v"] * unit}, own.flat)


def expected_average_value(
    model: GammaGamma, frequency: str = "frequency", value: str = "monetary_value"
) -> Column:
    """Expected value per purchase: own mean and population mean, weighted."""
    px = F.lit(model.p) * F.col(frequency)
    weight = px / (px + F.lit(model.q - 1.0))
    population = F.lit(model.v * model.p / (model.q - 1.0))
    return (F.lit(1.0) - weight) * population + weight * F.col(value)
