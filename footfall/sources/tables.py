"""Warehouse tables and parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.dates import day_of, month_start


def read_table(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A catalog table or view, or `<folder>/<name>.parquet` when a folder is given."""
    if folder is None:
        return spark.table(name)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_by_month(
    df: DataFrame, path: str, ts: str, rows_per_file: int = 20_000_000
) -> None:
    """Write a log partitioned by the month of `ts`, so date filters skip files.

    Months are rebalanced: adaptive execution splits a heavy month into as many
    tasks as its measured size asks for, and `rows_per_file` bounds a file.
    """
    (
        df.withColumn("month", month_start(day_of(F.col(ts))))
        .hint("rebalance", F.col("month"))
        .write.option("maxRecordsPerFile", rows_per_file)
        .mode("errorifexists")
        .partitionBy("month")
        .parquet(path)
    )


def read_months(spark: SparkSession, path: str, first, last) -> DataFrame:
    """Rows of the months from `first` to `last` (first days, inclusive)."""
    return spark.read.parquet(path).filter(F.col("month").between(first, last)).drop("month")
