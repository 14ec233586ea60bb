"""Keep the distinct (user, day) table up to date from arriving comment files.

An addition: the batch reports read the whole log, and this keeps a compact
table they can read instead (`ts="date"`). No state and no watermark is held:
each micro-batch appends its own distinct pairs, late days included, and the
reports drop repeated pairs anyway, so replays and late data change nothing but
the size of the table. `compact_days` rewrites days without the repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from footfall.operators.activity import user_days
from footfall.sources.csv_files import READ_OPTIONS


def comment_file_stream(
    spark: SparkSession, prefix: str, schema: T.StructType, files_per_batch: int = 1000
) -> DataFrame:
    """New CSV files below a prefix, as they arrive."""
    return (
        spark.readStream.schema(schema)
        .options(**READ_OPTIONS)
        # The header of each file must be the declared one; a file in another
        # layout fails the batch instead of being read by position.
        .option("enforceSchema", "false")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(prefix)
    )


def keep_user_days(
    log: DataFrame,
    table: str,
    checkpoint: str,
    user: str = "user_id",
    ts: str = "ts",
) -> StreamingQuery:
    """Process what has arrived and stop; a later start goes on from there."""

    def append(batch: DataFrame, _: int) -> None:
        # A busy day is split by its measured size, and a day still gets few files.
        pairs = user_days(batch, user, ts).hint("rebalance", F.col("date"))
        pairs.write.mode("append").partitionBy("date").parquet(table)

    return (
        log.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact_days(spark: SparkSession, table: str, target: str) -> None:
    """Write the table anew, each (user, day) once; `target` must not exist.

    The old table stays until its readers have moved on. No batch may be appended
    to it meanwhile.
    """
    days = spark.read.parquet(table).distinct()
    days.hint("rebalance", F.col("date")).write.mode("errorifexists").partitionBy("date").parquet(target)
