"""Exact interpolated quantiles of distributed columns.

Doubles have bits that sort like them. A pass counts the rows by their leading
bits, which says in which range of bits a wanted rank lies; the next passes read
on inside those ranges alone. Nothing is sorted, range-partitioned or written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.operators.ordering import in_slices

# Bits that a pass adds, rows below which a range is read by its distinct values, and
# metrics up to which ranges are held on the driver: 2**14 counts for each of them.
STEP = 14
FEW = 1 << STEP
MOST_METRICS = 64
_BITS = 64
_SIGN = 1 << (_BITS - 1)


def melt(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as (metric, value) rows, values as doubles; NaN becomes NULL."""
    pairs = [
        F.struct(
            F.lit(name).alias("metric"),
            F.nullif(F.col(name).cast("double"), F.lit(float("nan"))).alias("value"),
        )
        for name in columns
    ]
    return df.select(F.inline(F.array(*pairs)))


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers that sort like the doubles; -0.0 is 0.0, NaN the largest."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(_BITS - 1), ~bits, bits | np.uint64(_SIGN))


def from_ordered_bits(keys: np.ndarray) -> np.ndarray:
    negative = keys < np.uint64(_SIGN)
    return np.where(negative, ~keys, keys & np.uint64(_SIGN - 1)).view(np.float64)


# A range of bits: (prefix, shift) holds the keys with `key >> shift == prefix`.
_ALL = (0, _BITS)


def _counted(
    long: DataFrame, asked: dict[object, dict[tuple[int, int], int]] | None
) -> DataFrame:
    """(metric, prefix, shift, bucket, n): rows by their next bits in the asked ranges.

    `asked` names, for each metric and range, the shift of its buckets; None asks for
    the leading bits of every metric. Counts are combined in the map tasks.
    """
    start = {_ALL: _BITS - STEP}

    def count(batches):
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            keys = ordered_bits(batch.column(1).to_numpy(zero_copy_only=False))[order]
            ends = np.cumsum(np.bincount(codes, minlength=len(names.dictionary)))
            metric, parts = [], []
            for code, name in enumerate(names.dictionary.to_pylist()):
                own = keys[ends[code - 1] if code else 0 : ends[code]]
                ranges = start if asked is None else asked.get(name, {})
                for (prefix, shift), low in ranges.items():
                    if shift == _BITS:
                        inside = own
                    else:
                        inside = own[own >> np.uint64(shift) == np.uint64(prefix)]
                    found, n = np.unique(inside >> np.uint64(low), return_counts=True)
                    metric.append(np.full(len(found), code))
                    parts.append(
                        np.stack(
                            [
                                np.full(len(found), prefix, dtype=np.uint64).view(np.int64),
                                np.full(len(found), shift),
                                found.view(np.int64),
                                n,
                            ]
                        )
                    )
            if not parts:
                continue
            columns = np.concatenate(parts, axis=1)
            yield pa.RecordBatch.from_arrays(
                [names.dictionary.take(pa.array(np.concatenate(metric)))]
                + [pa.array(column) for column in columns],
                names=["metric", "prefix", "shift", "bucket", "n"],
            )

    kind = long.schema["metric"].dataType
    schema = T.StructType(
        [T.StructField("metric", kind)]
        + [T.StructField(name, T.LongType()) for name in ("prefix", "shift", "bucket", "n")]
    )
    return (
        long.filter(F.col("metric").isNotNull() & F.col("value").isNotNull())
        .select("metric", F.col("value").cast("double").alias("value"))
        .mapInArrow(count, schema)
        .groupBy("metric", "prefix", "shift", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def _tables(counts: pa.Table) -> dict[tuple[object, int, int], tuple[np.ndarray, np.ndarray]]:
    """(buckets in order, rows up to and with each) by metric and range."""
    metric = counts.column("metric").to_pylist()
    prefix, bucket = (
        counts.column(name).to_numpy().view(np.uint64) for name in ("prefix", "bucket")
    )
    shift, n = counts.column("shift").to_numpy(), counts.column("n").to_numpy()
    rows: dict[tuple[object, int, int], list[int]] = {}
    for at, key in enumerate(zip(metric, prefix.tolist(), shift.tolist(), strict=True)):
        rows.setdefault(key, []).append(at)
    found = {}
    for key, places in rows.items():
        order = np.array(places)[np.argsort(bucket[places])]
        found[key] = (bucket[order], np.cumsum(n[order]))
    return found


def quantiles_by_metric(long: DataFrame, probabilities: list[float]) -> DataFrame:
    """(metric, probability, value) with linear interpolation between ranks.

    `long` is read two to five times, so what is costly to compute should be written
    first. Rows without a metric or value do not count; metrics without values are
    missing in the result; NaN is the largest value. The driver holds the counts of
    one pass, at most 2**14 for each metric and wanted rank; tables of more
    metrics than `MOST_METRICS` are ranked by range partitions, with equal results.
    """
    counts = _counted(long, None)
    most = MOST_METRICS << STEP
    tables = _tables(counts.limit(most + 1).toArrow())
    if len(tables) > MOST_METRICS:
        return quantiles_by_slices(long, probabilities)

    spots = {}
    for name, *_ in tables:
        last = int(tables[(name, *_ALL)][1][-1]) - 1
        for p in probabilities:
            low = math.floor(p * last)
            spots[(name, p)] = (low, min(low + 1, last), p * last - low)
    # Where each wanted rank lies: its range, and the rows below the range.
    where = {
        (name, rank): (_ALL, 0) for (name, _), spot in spots.items() for rank in spot[:2]
    }
    steps: dict[object, dict[tuple[int, int], int]] = {
        name: {_ALL: _BITS - STEP} for name, *_ in tables
    }
    values: dict[tuple[object, int], float] = {}
    while where:
        asked: dict[object, dict[tuple[int, int], int]] = {}
        for (name, rank), (inside, before) in list(where.items()):
            buckets, upto = tables[(name, *inside)]
            at = int(np.searchsorted(upto, rank - before, side="right"))
            below = int(upto[at - 1]) if at else 0
            low = steps[name][inside]
            if low == 0:
                values[(name, rank)] = float(from_ordered_bits(buckets[at : at + 1])[0])
                del where[(name, rank)]
                continue
            here = (int(buckets[at]), low)
            few = int(upto[at]) - below <= FEW
            asked.setdefault(name, {})[here] = 0 if few else max(0, low - STEP)
            where[(name, rank)] = (here, before + below)
        if where:
            tables, steps = _tables(_counted(long, asked).toArrow()), asked

    rows = [
        (name, p, values[(name, low)] + (values[(name, high)] - values[(name, low)]) * fraction)
        for (name, p), (low, high, fraction) in spots.items()
    ]
    schema = T.StructType(
        [
            T.StructField("metric", long.schema["metric"].dataType),
            T.StructField("probability", T.DoubleType()),
            T.StructField("value", T.DoubleType()),
        ]
    )
    return long.sparkSession.createDataFrame(rows, schema)


def quantiles_by_slices(long: DataFrame, probabilities: list[float]) -> DataFrame:
    """The same for any number of metrics, by one sort.

    Equal values are counted before the shuffle and the distinct values are
    range-partitioned, so neither a frequent value nor a large metric meets in
    one task. Only the slices holding a wanted rank are ranked row by row.
    """
    counts = (
        long.filter(F.col("value").isNotNull())
        .groupBy("metric", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sliced = in_slices(counts, ["metric", "value"]).drop("_place")

    # At most one row per slice and metric.
    totals = sliced.groupBy("metric", "_slice").agg(F.sum("n").alias("held"))
    by_metric = Window.partitionBy("metric")
    before = by_metric.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "metric",
        "_slice",
        "held",
        F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"),
        F.sum("held").over(by_metric).alias("total"),
    )
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    spot = F.col("probability") * (F.col("total") - 1)
    # At most two slices per metric and probability.
    targets = (
        offsets.withColumn("probability", F.explode(wanted))
        .withColumn("low", F.floor(spot))
        .withColumn("fraction", spot - F.col("low"))
        .withColumn("high", F.least(F.col("low") + 1, F.col("total") - 1))
        .filter(
            (F.col("before") <= F.col("high"))
            & (F.col("before") + F.col("held") > F.col("low"))
        )
        .select("metric", "_slice", "before", "probability", "low", "high", "fraction")
    )
    running = Window.partitionBy("metric", "probability", "_slice").orderBy("value")
    ranked = (
        sliced.join(targets, ["metric", "_slice"])
        .withColumn("upto", F.col("before") + F.sum("n").over(running))
        .withColumn("from", F.col("upto") - F.col("n"))
    )
    holds_low = (F.col("from") <= F.col("low")) & (F.col("low") < F.col("upto"))
    holds_high = (F.col("from") <= F.col("high")) & (F.col("high") < F.col("upto"))
    found = (
        ranked.filter(holds_low | holds_high)
        .groupBy("metric", "probability", "fraction")
        .agg(
            F.max(F.when(holds_low, F.col("value"))).alias("_v0"),
            F.max(F.when(holds_high, F.col("value"))).alias("_v1"),
        )
    )
    return found.select(
        "metric",
        "probability",
        (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("fraction")).alias("value"),
    )


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    return quantiles_by_metric(melt(df, columns), sorted(set(probabilities)))


def quantile_edges(
    df: DataFrame, columns: list[str], probabilities: list[float]
) -> dict[tuple[str, float], float]:
    """The same values as Python numbers: columns x probabilities of them."""
    rows = exact_quantiles(df, columns, probabilities).collect()
    edges = {(row["metric"], row["probability"]): row["value"] for row in rows}
    return {
        (column, p): edges.get((column, float(p)), math.nan)
        for column in columns
        for p in probabilities
    }
