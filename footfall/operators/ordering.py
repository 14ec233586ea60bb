"""Positions in a total order, without passing the table through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.session import materialise

# monotonically_increasing_id keeps the partition in the bits above these.
_ROW_BITS = 33


def in_slices(df: DataFrame, keys: list[str]) -> DataFrame:
    """Range-partition and sort by the keys, and keep each row's slice and place.

    Slice bounds come from a sample, so the layout is written out once; later
    steps, retries included, read the same slices.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = materialise(ordered.withColumn("_id", F.monotonically_increasing_id()))
    return numbered.withColumns(
        {
            "_slice": F.shiftright("_id", _ROW_BITS),
            "_place": F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    ).drop("_id")


def with_position(df: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2, … in the order of the keys (unique together)."""
    sliced = in_slices(df, keys)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice, so its size is bounded by the number of partitions.
    offsets = (
        sliced.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    return (
        sliced.join(F.broadcast(offsets), "_slice")
        .withColumn(position, F.col("_before") + F.col("_place"))
        .drop("_slice", "_place", "_before")
    )


def moving_average(
    df: DataFrame,
    value: str,
    keys: list[str],
    rows: int = 14,
    name: str = "moving_average",
    block: int = 100_000,
) -> DataFrame:
    """Mean of the last `rows` rows in key order; NULL until there are that many.

    Positions are cut into blocks and each block also receives the last
    `rows - 1` rows of the one before, so blocks are averaged independently.
    """
    block = max(block, rows)
    placed = with_position(df, keys, "_position").withColumn(
        "_own", F.floor(F.col("_position") / block)
    )
    near_end = F.col("_position") % block >= block - (rows - 1)
    spread = placed.withColumn(
        "_block",
        F.explode(
            F.when(near_end, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(
                F.array(F.col("_own"))
            )
        ),
    )
    window = Window.partitionBy("_block").orderBy("_position").rowsBetween(-(rows - 1), 0)
    averaged = spread.withColumn(name, F.avg(value).over(window)).filter(
        F.col("_own") == F.col("_block")
    )
    return averaged.withColumn(
        name, F.when(F.col("_position") >= rows - 1, F.col(name))
    ).drop("_position", "_own", "_block")
