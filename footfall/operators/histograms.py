"""Equal-width histograms and a Gaussian density curve."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.quantiles import melt


def histograms(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """(metric, bin, lower, upper, cnt), empty bins included, last bin closed.

    A constant column gets a range of width one around its value. The bounds
    are one row per metric.
    """
    long = melt(df, columns).filter(F.col("value").isNotNull())
    low = F.min("value")
    high = F.max("value")
    bounds = long.groupBy("metric").agg(
        F.when(low == high, low - 0.5).otherwise(low).alias("low"),
        F.when(low == high, high + 0.5).otherwise(high).alias("high"),
    )
    # One row per metric, named by the caller.
    placed = long.join(F.broadcast(bounds), "metric")
    counts = placed.groupBy(
        "metric", _bin(F.col("value"), F.col("low"), F.col("high"), bins).alias("bin")
    ).agg(F.count(F.lit(1)).alias("cnt"))
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, ["metric", "bin"], "left").select(
        "metric",
        "bin",
        _edge(F.col("bin"), F.col("low"), F.col("high"), bins).alias("lower"),
        _edge(F.col("bin") + 1, F.col("low"), F.col("high"), bins).alias("upper"),
        F.coalesce("cnt", F.lit(0)).alias("cnt"),
    )


def _edge(index: Column, low: Column, high: Column, bins: int) -> Column:
    inner = low + index.cast("double") * ((high - low) / F.lit(float(bins)))
    return F.when(index == bins, high).otherwise(inner)


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin by division, then moved by one where rounding crossed an edge."""
    guess = F.least(
        F.floor((value - low) / (high - low) * F.lit(float(bins))).cast("int"), F.lit(bins - 1)
    )
    return (
        F.when(value < _edge(guess, low, high, bins), guess - 1)
        .when((guess < bins - 1) & (value >= _edge(guess + 1, low, high, bins)), guess + 1)
        .otherwise(guess)
    )


def density_curve(
    df: DataFrame, column: str, bins: int = 8, points: int = 200
) -> DataFrame:
    """Gaussian kernel density on an even grid from minimum to maximum.

    The bandwidth follows Scott's rule; a column without spread has no curve, and
    NULL and NaN take no part. `scaled` is the density times row count times bin
    width, to lie over a histogram of counts. Equal values are counted first;
    each task then folds its values into one sum per grid point.
    """
    value = F.nullif(F.col(column).cast("double"), F.lit(float("nan")))
    values = df.select(value.alias("value")).filter(F.col("value").isNotNull())
    shape = values.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.stddev_samp("value").alias("spread"),
    ).withColumn("h", F.col("spread") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    row = shape.first()
    n, low, high, h = row["n"], row["low"], row["high"], row["h"]
    schema = "point int, kernel double"
    if not h or h <= 0:
        grid = df.sparkSession.createDataFrame([], schema)
        n, low, high, h = 1, 0.0, 0.0, 1.0
    else:
        x = low + np.arange(points) * ((high - low) / (points - 1))

        def fold(batches):
            sums = np.zeros(points)
            for batch in batches:
                own, times = batch["value"].to_numpy(), batch["times"].to_numpy()
                for start in range(0, len(own), 1000):
                    z = (x - own[start : start + 1000, None]) / h
                    sums += times[start : start + 1000] @ np.exp(z * z * -0.5)
            yield pd.DataFrame({"point": np.arange(points, dtype="int32"), "kernel": sums})

        counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("times"))
        grid = counted.mapInPandas(fold, schema).groupBy("point").agg(
            F.sum("kernel").alias("kernel")
        )
    density = F.col("kernel") / (F.lit(n) * F.lit(h) * F.sqrt(F.lit(2.0) * F.pi()))
    width = (high - low) / bins
    return grid.select(
        "point",
        (F.lit(low) + F.col("point") * F.lit((high - low) / (points - 1))).alias("x"),
        density.alias("density"),
        (density * F.lit(n) * F.lit(width)).alias("scaled"),
    )
