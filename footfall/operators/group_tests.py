"""Two-sample tests: Brown-Forsythe equality of variance and Welch's t."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.special import f_upper_tail, student_two_sided
from footfall.operators.quantiles import quantiles_by_metric


@F.pandas_udf(T.DoubleType())
def _student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    pairs = zip(t, df, strict=True)
    return pd.Series([None if pd.isna(a) or pd.isna(b) else student_two_sided(a, b) for a, b in pairs])


@F.pandas_udf(T.DoubleType())
def _f_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    rows = zip(f, df1, df2, strict=True)
    return pd.Series([None if pd.isna(a) else f_upper_tail(a, b, c) for a, b, c in rows])


def split_by_parts(series: DataFrame, count: str = "series_cnt", value: str = "cookie_mean") -> DataFrame:
    """(grp, value): series of two or more parts against single episodes."""
    group = F.when(F.col(count) >= 2, "series").when(F.col(count) == 1, "single")
    return series.select(group.alias("grp"), F.col(value).cast("double").alias("value")).dropna()


def welch_test(samples: DataFrame, first: str = "series", second: str = "single") -> DataFrame:
    """t, degrees of freedom and two-sided p of `first` minus `second`, one row.

    Moments are folded in the tasks; the p-value is computed on the one
    resulting row. Too small groups give NULLs.
    """
    moments = []
    for side, name in (("1", first), ("2", second)):
        own = F.when(F.col("grp") == name, F.col("value"))
        moments += [
            F.count(own).alias("n" + side),
            F.avg(own).alias("mean" + side),
            F.var_samp(own).alias("var" + side),
        ]
    row = samples.agg(*moments)
    part1 = F.try_divide("var1", "n1")
    part2 = F.try_divide("var2", "n2")
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(part1 + part2))
    df = F.try_divide(
        F.pow(part1 + part2, F.lit(2.0)),
        F.try_divide(F.pow(part1, F.lit(2.0)), F.col("n1") - 1)
        + F.try_divide(F.pow(part2, F.lit(2.0)), F.col("n2") - 1),
    )
    enough = (F.col("n1") > 1) & (F.col("n2") > 1)
    tested = row.withColumns(
        {"t_statistic": F.when(enough, t), "df": F.when(enough, df)}
    )
    return tested.withColumn("p_value", _student_p("t_statistic", "df"))


def levene_test(samples: DataFrame) -> DataFrame:
    """Median-centred Levene statistic and p over all groups, one row."""
    long = samples.select(F.col("grp").alias("metric"), "value")
    # One median per group.
    medians = quantiles_by_metric(long, [0.5]).select(
        F.col("metric").alias("grp"), F.col("value").alias("median")
    )
    spread = samples.join(medians, "grp").withColumn(
        "z", F.abs(F.col("value") - F.col("median"))
    )
    groups = spread.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("z").alias("mean"),
        (F.var_pop("z") * F.count(F.lit(1))).alias("within"),
    )
    # Spread of the group means around the grand mean, each weighed by its group:
    # the population variance of the pairs (mean, n), from one pass.
    totals = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("mean")).alias("first"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("second"),
        F.sum("within").alias("within"),
    ).withColumn("between", F.col("second") - F.col("first") * F.col("first") / F.col("total"))
    statistic = F.try_divide(
        (F.col("total") - F.col("k")) * F.col("between"), (F.col("k") - 1) * F.col("within")
    )
    return totals.select(
        F.col("k").alias("groups"),
        F.col("total").alias("n"),
        statistic.alias("f_statistic"),
        (F.col("k") - 1).alias("df1"),
        (F.col("total") - F.col("k")).alias("df2"),
    ).withColumn(
        "p_value",
        _f_p("f_statistic", F.col("df1").cast("double"), F.col("df2").cast("double")),
    )
