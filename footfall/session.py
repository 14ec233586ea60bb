"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans joins from measured sizes and splits hot join
# partitions; both are relied on by the joins in `operators`.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app: str = "footfall",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint directory.

    A session without the setting works below its warehouse, which Spark's own
    tables already need all executors to reach; that folder goes with the session.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        configured = f"{warehouse}/_work-{uuid.uuid4().hex}"
        _delete_at_end(spark, configured)
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _delete_at_end(spark: SparkSession, path: str) -> None:
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the session ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _delete_at_end(spark, path)
    return path


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later step reads."""
    files, where = _hadoop(spark, path)
    files.delete(where, True)


def materialise(df: DataFrame) -> DataFrame:
    """Evaluate once into reliable storage and cut the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
