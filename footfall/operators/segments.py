"""Customer segments, percentile bands and promotion cost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.numbers import round_half_even
from footfall.operators.quantiles import exact_quantiles, quantile_edges

# Lower quantile of each segment above the lowest.
SEGMENT_QUANTILES = (0.4, 0.6, 0.8)
SEGMENT_NAMES = ("silver", "gold", "platinum", "diamond")


def segment_label(value: Column, edges: tuple[float, float, float]) -> Column:
    """Segment of a value; a value on an edge belongs to the lower segment."""
    silver, gold, platinum, diamond = SEGMENT_NAMES
    return (
        F.when(value <= edges[0], silver)
        .when(value <= edges[1], gold)
        .when(value <= edges[2], platinum)
        .when(value > edges[2], diamond)
    )


def with_segment(customers: DataFrame, value: str = "ltv") -> DataFrame:
    found = quantile_edges(customers, [value], list(SEGMENT_QUANTILES))
    edges = tuple(found[(value, p)] for p in SEGMENT_QUANTILES)
    return customers.withColumn("segment", segment_label(F.col(value), edges))


def with_dayparts(customers: DataFrame, shares: DataFrame, user: str = "user_id") -> DataFrame:
    """Both sides hold one row per user."""
    return customers.join(shares, user, "inner")


def top_share_thresholds(
    customers: DataFrame, columns: list[str], probability: float = 0.8
) -> DataFrame:
    """Value that starts the top share of each metric, and its whole part."""
    return exact_quantiles(customers, columns, [probability]).withColumn(
        "value_int", F.col("value").cast("long")
    )


def band_edges(
    customers: DataFrame, bands: Mapping[str, tuple[int, int]]
) -> dict[str, tuple[float, float]]:
    """Value range of a "top lo % to top hi %" band per metric.

    The usual widest band (1, 100) still leaves out values above the 99th
    percentile.
    """
    probabilities = sorted({(100 - share) / 100 for band in bands.values() for share in band})
    edges = quantile_edges(customers, list(bands), probabilities)
    return {
        metric: (edges[(metric, (100 - hi) / 100)], edges[(metric, (100 - lo) / 100)])
        for metric, (lo, hi) in bands.items()
    }


def in_bands(customers: DataFrame, bands: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Customers inside every band, edges included."""
    kept = customers
    for metric, (low, high) in band_edges(customers, bands).items():
        kept = kept.filter(F.col(metric).between(low, high))
    return kept


def main_time(morning_ratio: Column, day_ratio: Column, threshold: int = 50) -> Column:
    return F.when(morning_ratio + day_ratio >= threshold, "morning/day").otherwise("other")


def segment_time_counts(customers: DataFrame) -> DataFrame:
    labelled = customers.withColumn(
        "time", main_time(F.col("morning_ratio"), F.col("day_ratio"))
    )
    return labelled.groupBy("segment", "time").agg(F.count("segment").alias("segment_cnt"))


def promotion_cost(counts: DataFrame, per_head: int = 1000) -> DataFrame:
    by_day = F.when(F.col("time") == "morning/day", F.col("segment_cnt"))
    return counts.agg(
        F.coalesce(F.sum("segment_cnt") * per_head, F.lit(0)).alias("total_cost"),
        F.coalesce(F.sum(by_day) * per_head, F.lit(0)).alias("morning_day_cost"),
    )


def segment_profile(customers: DataFrame) -> DataFrame:
    return customers.groupBy("segment").agg(
        F.avg("monetary_value").alias("monetary_value"),
        F.avg("ltv").alias("ltv"),
        F.sum("morning").alias("morning"),
        F.sum("day").alias("day"),
        F.sum("night").alias("night"),
    )


def total_value(customers: DataFrame, value: str = "ltv") -> DataFrame:
    return customers.agg(round_half_even(F.sum(value)).alias(f"{value}_sum"))
