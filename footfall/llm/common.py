"""Helpers shared by the operators: words, tables, written stages."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of `WORD` in a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased.

    `bytes.split` parts at exactly the six ASCII white-space bytes of `WORD`, and
    `bytes.lower` touches A-Z alone.
    """
    return text.lower().split() if text else []


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def remainder_of(key: Column, modulus: int) -> Column:
    """crc32 of a key written as text, modulo; a null key counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(modulus))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Workspace:
    """Written intermediate tables of one run, below the shared folder.

    Writing cuts the lineage: a lost executor costs only the tasks since the
    last written table. Tables are dropped once no later step reads them; what
    the returned DataFrame still reads goes when the session ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._hadoop)

    def stage(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        target = f"{self.path}/{name}"
        df.write.parquet(target, compression=codec)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            self._files.delete(path, True)


def runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal keys in sorted arrays."""
    size = len(keys[0])
    if not size:
        return
    changed = np.zeros(size - 1, dtype=bool)
    for key in keys:
        changed |= key[1:] != key[:-1]
    edges = np.flatnonzero(changed) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), size], strict=True)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of a stream sorted by its first `keys` columns, no group split.

    Holds one batch and the group that goes on into the next one.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        same = np.ones(held.num_rows, dtype=bool)
        for i in range(keys):
            column = held.column(i)
            same &= column.to_numpy() == column[held.num_rows - 1].as_py()
        cut = int(np.argmax(same))
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None:
        yield held.combine_chunks()
