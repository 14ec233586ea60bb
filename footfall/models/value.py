"""Lifetime value, holdout scores and the penalty grid."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.models.bgnbd import BetaGeo, customer_cells, expected_purchases_at, fit_bgnbd
from footfall.models.gammagamma import (
    GammaGamma,
    expected_average_value,
    fit_gammagamma,
    repeat_spend,
)
from footfall.models.fitting import settled_only, spread_out
from footfall.session import materialise

DAYS_PER_MONTH = 30


def fit_both(
    customers: DataFrame,
    purchase_penalties: Sequence[float],
    spend_penalties: Sequence[float],
    suffix: str = "",
    strict: bool = True,
) -> tuple[list[BetaGeo], list[GammaGamma]]:
    """Purchase and spend models of repeat customers.

    The two searches are independent rows of short jobs, so they are submitted
    side by side. `suffix` picks the summary columns, e.g. `_cal`. A search that
    did not converge, or a spend model without a population mean, raises; with
    `strict=False` it is returned, and scores mark it as not usable.
    """
    repeat = customers.filter(F.col(f"frequency{suffix}") > 0)
    cells = customer_cells(repeat, f"frequency{suffix}", f"recency{suffix}", f"T{suffix}")
    spend = repeat_spend(repeat, f"frequency{suffix}", f"monetary_value{suffix}")
    with ThreadPoolExecutor(max_workers=2) as pool:
        purchases = pool.submit(fit_bgnbd, cells, purchase_penalties)
        values = pool.submit(fit_gammagamma, spend, spend_penalties)
        fitted, priced = purchases.result(), values.result()
    if strict:
        settled_only(fitted)
        settled_only(priced)
        wild = [m.penalty for m in priced if not m.bounded]
        if wild:
            raise RuntimeError(f"spend models without a population mean for penalties {wild}")
    return fitted, priced


def with_lifetime_value(
    customers: DataFrame,
    purchases: BetaGeo,
    spend: GammaGamma,
    months: int = 8,
    monthly_rate: float = 0.01,
) -> DataFrame:
    """Add `ltv`, `predicted_purchases` and `predicted_monetary_value`.

    Purchases expected in each 30-day month are discounted to today and
    multiplied by the expected value per purchase. One Arrow pass returns the
    discounted and the plain purchase sums.
    """

    @F.pandas_udf("discounted double, plain double")
    def ahead(x: pd.Series, t: pd.Series, end: pd.Series) -> pd.DataFrame:
        x, t, end = (v.to_numpy(float) for v in (x, t, end))
        before = np.zeros(len(x))
        discounted = np.zeros(len(x))
        for month in range(1, months + 1):
            upto = expected_purchases_at(purchases, float(DAYS_PER_MONTH * month), x, t, end)
            discounted += (upto - before) / (1.0 + monthly_rate) ** month
            before = upto
        return pd.DataFrame({"discounted": discounted, "plain": before})

    return (
        customers.withColumn("_ahead", ahead("frequency", "recency", "T"))
        .withColumn("predicted_monetary_value", expected_average_value(spend))
        .withColumn("ltv", F.col("predicted_monetary_value") * F.col("_ahead.discounted"))
        .withColumn("predicted_purchases", F.col("_ahead.plain"))
        .drop("_ahead")
    )


def error_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean squared error, its root, and mean absolute error."""
    error = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae")).select(
        "mse", F.sqrt("mse").alias("rmse"), "mae"
    )


@dataclass(frozen=True)
class _Scored:
    """What one label predicts: errors of all its models over a batch of columns."""

    label: str
    columns: tuple[str, ...]
    errors: Callable[..., np.ndarray]
    usable: dict[float, bool]


def _purchase_errors(models: Sequence[BetaGeo]) -> _Scored:
    chosen = list(models)

    def errors(x, t, end, horizon, actual):
        return np.stack(
            [actual - expected_purchases_at(m, horizon, x, t, end) for m in chosen], axis=1
        )

    columns = ("frequency_cal", "recency_cal", "T_cal", "duration_holdout", "frequency_holdout")
    return _Scored("bgnbd", columns, errors, {m.penalty: m.converged for m in chosen})


def _spend_errors(models: Sequence[GammaGamma], from_holdout: bool) -> _Scored:
    p, q, v = (np.array([getattr(m, name) for m in models]) for name in ("p", "q", "v"))
    part = "holdout" if from_holdout else "cal"

    def errors(x, m, actual):
        weight = p * x[:, None] / (p * x[:, None] + q - 1.0)
        return actual[:, None] - ((1.0 - weight) * v * p / (q - 1.0) + weight * m[:, None])

    return _Scored(
        "gammagamma_holdout" if from_holdout else "gammagamma_forecast",
        (f"frequency_{part}", f"monetary_value_{part}", "monetary_value_holdout"),
        errors,
        {m.penalty: m.converged and m.bounded for m in models},
    )


def score_purchases(holdout: DataFrame, models: Sequence[BetaGeo]) -> DataFrame:
    """Squared and absolute holdout error of many models in one pass."""
    return _score(holdout, [_purchase_errors(models)])


def score_spend(
    holdout: DataFrame, models: Sequence[GammaGamma], from_holdout: bool = True
) -> DataFrame:
    """Holdout error of predicted value per purchase.

    With `from_holdout` the prediction uses the holdout's own frequency and
    value, as the published figure does; without, it uses calibration values
    and is a true forecast error.
    """
    return _score(holdout, [_spend_errors(models, from_holdout)])


def score_both(
    holdout: DataFrame, purchases: Sequence[BetaGeo], spend: Sequence[GammaGamma]
) -> DataFrame:
    """Purchase errors and both kinds of spend errors, from one pass over the customers."""
    return _score(
        holdout,
        [_purchase_errors(purchases), _spend_errors(spend, True), _spend_errors(spend, False)],
    )


def _score(df: DataFrame, parts: Sequence[_Scored]) -> DataFrame:
    """(model, l2, customers, mse, rmse, mae, usable); a task emits one row per model.

    `usable` is false for a fit that did not converge or has no finite mean.
    """
    columns = list(dict.fromkeys(c for part in parts for c in part.columns))

    def fold(batches):
        rows = 0
        squared = [np.zeros(len(part.usable)) for part in parts]
        absolute = [np.zeros(len(part.usable)) for part in parts]
        for batch in batches:
            rows += len(batch)
            for k, part in enumerate(parts):
                off = part.errors(*(batch[c].to_numpy(dtype=float) for c in part.columns))
                squared[k] += (off**2).sum(axis=0)
                absolute[k] += np.abs(off).sum(axis=0)
        for k, part in enumerate(parts):
            yield pd.DataFrame(
                {
                    "model": part.label, "l2": list(part.usable), "rows": rows, "squared": squared[k],
                    "absolute": absolute[k], "usable": list(part.usable.values()),
                }
            )

    schema = "model string, l2 double, rows long, squared double, absolute double, usable boolean"
    summed = (
        df.select(*columns)
        .mapInPandas(fold, schema)
        .groupBy("model", "l2", "usable")
        .agg(
            F.sum("rows").alias("customers"),
            F.sum("squared").alias("squared"),
            F.sum("absolute").alias("absolute"),
        )
    )
    mse = F.try_divide("squared", "customers")
    return summed.select(
        "model",
        "l2",
        "customers",
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.try_divide("absolute", "customers").alias("mae"),
        "usable",
    )


def refined_penalties(scores: DataFrame, penalties: Sequence[float], between: int = 8) -> dict[str, list[float]]:
    """For each model, penalties inside the bracket around its best one.

    The bracket reaches to the neighbours of the best; `between` penalties are laid
    evenly by order of magnitude on either side of it. A best one at an end of the
    grid is bracketed on its one side.
    """
    grid = sorted(penalties)
    found = {}
    for row in scores.filter("best").select("model", "l2").collect():
        at = grid.index(row["l2"])
        ends = [grid[max(at - 1, 0)], grid[at], grid[min(at + 1, len(grid) - 1)]]
        found[row["model"]] = [
            float(low * (high / low) ** (k / (between + 1)))
            for low, high in zip(ends, ends[1:], strict=False)
            if low < high
            for k in range(1, between + 1)
        ]
    return found


def _ranked(scores: DataFrame) -> DataFrame:
    # Three rankings times the number of penalties.
    order = Window.partitionBy("model").orderBy(F.desc("usable"), "mse", "l2")
    return scores.withColumn("best", (F.row_number().over(order) == 1) & F.col("usable"))


def _grid_scores(kept: DataFrame, penalties: Sequence[float]) -> DataFrame:
    purchases, spend = fit_both(kept, penalties, penalties, "_cal", strict=False)
    # Each customer meets every model: spread over all cores, not by bytes.
    return score_both(spread_out(kept), purchases, spend)


def penalty_grid(holdout: DataFrame, penalties: Sequence[float]) -> DataFrame:
    """Holdout error of both models for each penalty; `best` marks the lowest.

    The spend model is ranked twice: by the published score, which predicts from
    holdout values, and by its true forecast error. Only usable fits can be best.
    `at_edge` marks penalties at an end of the grid: a best one there says that
    the optimum may lie outside. All penalties share every pass over the data.
    """
    kept = materialise(holdout.filter(F.col("frequency_cal") > 0))
    edges = [min(penalties), max(penalties)]
    return _ranked(_grid_scores(kept, penalties)).withColumn("at_edge", F.col("l2").isin(edges))


def penalty_search(holdout: DataFrame, penalties: Sequence[float], between: int = 8) -> DataFrame:
    """Best penalty of each ranking: the grid, then once more inside the bracket around its best.

    Returns one row per ranking with the scores of `penalty_grid`, `grid_l2`, the
    best of the grid, and `at_edge`. A model that has no usable fit gives no row.
    """
    kept = materialise(holdout.filter(F.col("frequency_cal") > 0))
    first = materialise(_ranked(_grid_scores(kept, penalties)))
    finer = refined_penalties(first, penalties, between)
    tried = sorted({p for own in finer.values() for p in own})
    coarse = first.filter("best")
    # One row per ranking and penalty.
    both = coarse.drop("best")
    if tried:
        inside = F.lit(False)
        for model, own in finer.items():
            inside = inside | ((F.col("model") == model) & F.col("l2").isin(own))
        both = both.unionByName(_grid_scores(kept, tried).filter(inside))
    edges = [min(penalties), max(penalties)]
    return (
        _ranked(both)
        .filter("best")
        .join(coarse.select("model", F.col("l2").alias("grid_l2")), "model")
        .withColumn("at_edge", F.col("l2").isin(edges))
        .drop("best")
    )
