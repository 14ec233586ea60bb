"""CSV folders in, CSV folders out."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READ_OPTIONS = {"header": "true", "encoding": "UTF-8", "escape": '"', "mode": "FAILFAST"}
SURPLUS = "_surplus"


def read_csv_folder(
    spark: SparkSession,
    prefix: str | list[str],
    schema: T.StructType,
    suffix: str = ".csv",
    recursive: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """Every file below a prefix that ends in the suffix, as one table.

    All files must carry the declared header. `multiline` allows line breaks
    inside quoted fields, at the price of one task per file.
    """
    return (
        spark.read.schema(schema)
        .options(**READ_OPTIONS)
        .option("enforceSchema", "false")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("multiLine", str(multiline).lower())
        .csv(prefix)
    )


def _files(reader, suffix: str):
    return reader.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true")


def _first_lines(spark: SparkSession, prefix: str, suffix: str) -> DataFrame:
    """(path, line, value) of the split that begins each file, in order of `line`."""
    return (
        _files(spark.read, suffix)
        .text(prefix)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
        .filter(F.col("start") == 0)
        .drop("start")
    )


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first record of each file from its lines in order: lines until all quotes are closed."""
    done, path, held = None, None, []
    for batch in batches:
        paths = batch.column(0)
        if done is not None and paths[0].as_py() == done == paths[-1].as_py():
            continue
        found: list[tuple[str, str]] = []
        for own, value in zip(paths.to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own == done:
                continue
            if own != path:
                if held:
                    found.append((path, "\n".join(held)))
                path, held = own, []
            held.append(value)
            if sum(line.count('"') for line in held) % 2 == 0:
                found.append((path, "\n".join(held)))
                done, path, held = own, None, []
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["path", "header"]
            )
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array(["\n".join(held)])], names=["path", "header"])


def file_headers(
    spark: SparkSession, prefix: str, suffix: str = ".csv", multiline: bool = False
) -> DataFrame:
    """(path, header record) of every file, from one text scan.

    The header is the first record of the split that begins the file. Without
    `multiline` it is one line, folded in the map tasks; with it, lines are read on
    until the quotes of the record are closed.
    """
    lines = _first_lines(spark, prefix, suffix)
    if multiline:
        first = lines.select("path", "value").mapInArrow(_whole_records, "path string, header string")
    else:
        first = lines.groupBy("path").agg(F.min_by("value", "line").alias("header"))
    return first.withColumn("header", F.regexp_replace("header", "^\ufeff|\r$", ""))


def header_names(header: str) -> list[str]:
    """Column names of a header record.

    A name that repeats gets `.1`, `.2` and so on, and one without a name is
    `Unnamed: ` with its place, so that every place can be kept.
    """
    names: list[str] = []
    for place, name in enumerate(next(csv.reader(io.StringIO(header, newline="")), [])):
        name, again = name or f"Unnamed: {place}", 0
        while (f"{name}.{again}" if again else name) in names:
            again += 1
        names.append(f"{name}.{again}" if again else name)
    return names


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cells_beyond(record: pd.Series, width: pd.Series) -> pd.Series:
    """Cells of a raw record from place `width` on; null without a record."""

    def cut(raw, at):
        if raw is None:
            return None
        cells = next(csv.reader(io.StringIO(raw, newline="")), [])
        return [cell or None for cell in cells[int(at) :]]

    return pd.Series([cut(r, w) for r, w in zip(record, width, strict=True)], dtype=object)


def read_csv_union(
    spark: SparkSession,
    prefix: str,
    schema: T.StructType,
    suffix: str = ".csv",
    multiline: bool = False,
    undeclared: str = "keep",
    surplus: str = "keep",
) -> DataFrame:
    """Union of files whose headers differ, matched by column name.

    Columns absent from a file are NULL. Columns outside the schema are kept as
    text after the declared ones; `undeclared="fail"` raises on them and
    `"drop"` leaves them out. All files are read in one scan by position, with as
    many places as the widest header, and each row takes its names from the
    header of its file. Only the distinct headers reach the driver. A cell that
    does not parse as its declared type fails the job; a row with fewer cells is
    filled with NULL.

    Cells beyond a file's own header come last, as the array `_surplus`, null for
    rows without any; `surplus="fail"` raises with path and record instead, and
    `"drop"` leaves them out. A header with a line break inside quotes needs
    `multiline`, as rows with one do; without it, it raises.
    """
    for name, given in (("undeclared", undeclared), ("surplus", surplus)):
        if given not in ("keep", "fail", "drop"):
            raise ValueError(f"{name} must be 'keep', 'fail' or 'drop'")
    headers = file_headers(spark, prefix, suffix, multiline)
    layouts = {
        row["header"]: header_names(row["header"])
        for row in headers.select("header").distinct().collect()
    }
    broken = [header for header in layouts if header.count('"') % 2]
    if broken:
        raise ValueError(f"a header goes on after its line ends, read with multiline: {broken[:3]}")
    declared = {field.name: field.dataType for field in schema.fields}
    extra = sorted({name for names in layouts.values() for name in names} - set(declared))
    if extra and undeclared == "fail":
        raise ValueError(f"columns outside the schema: {extra}")
    if undeclared == "drop":
        extra = []
    wanted = declared | {name: T.StringType() for name in extra}
    kept = surplus == "keep"
    widest = max((len(names) for names in layouts.values()), default=0)
    if not widest:
        return spark.createDataFrame([], T.StructType(
            [*schema.fields, *([T.StructField(SURPLUS, T.ArrayType(T.StringType()))] if kept else [])]
        ))
    places = [f"_c{i}" for i in range(widest)]
    # Rows that do not have exactly the widest number of cells also give their raw record.
    raw = [] if surplus == "drop" else ["_raw"]
    rows = (
        _files(spark.read, suffix)
        .schema(", ".join(f"{place} string" for place in [*places, *raw]))
        .options(**READ_OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"})
        .option("multiLine", str(multiline).lower())
        .csv(prefix)
        .select(F.col("_metadata.file_path").alias("_path"), *places, *raw)
    )
    named = rows.join(headers.withColumnRenamed("path", "_path"), "_path")

    def cell(name: str) -> F.Column:
        places_of: dict[int, list[str]] = {}
        for header, names in layouts.items():
            if name in names:
                places_of.setdefault(names.index(name), []).append(header)
        found = F.lit(None).cast("string")
        for place, of in sorted(places_of.items()):
            found = F.when(F.col("header").isin(of), F.col(places[place])).otherwise(found)
        return found.cast(wanted[name]).alias(name)

    if surplus == "drop":
        return named.select(*[cell(name) for name in wanted])
    width = F.lit(0)
    for count in sorted({len(names) for names in layouts.values()}):
        width = F.when(F.col("header").isin([h for h, n in layouts.items() if len(n) == count]), count).otherwise(width)
    # Only records with more separators than the widest header can hold more cells than were read.
    longer = F.regexp_count("_raw", F.lit(",")) >= widest
    beyond = F.coalesce(
        _cells_beyond(F.when(longer, F.col("_raw")), F.col("_width")),
        F.slice(F.array(*places), F.col("_width") + 1, F.lit(widest)),
    )
    named = named.withColumn("_width", width).withColumn(SURPLUS, beyond)
    named = named.withColumn(SURPLUS, F.when(F.exists(SURPLUS, lambda c: c.isNotNull()), F.col(SURPLUS)))
    if not kept:
        told = F.concat(
            F.lit("cells beyond the header in "), "_path", F.lit(": "),
            F.coalesce("_raw", F.array_join(F.array(*places), ",", "")),
        )
        named = named.filter(F.when(F.col(SURPLUS).isNull(), True).otherwise(F.raise_error(told).cast("boolean")))
        return named.select(*[cell(name) for name in wanted])
    return named.select(*[cell(name) for name in wanted], SURPLUS)


def write_csv_folder(df: DataFrame, path: str) -> None:
    """Header, UTF-8, no index column; one file per partition."""
    (
        df.write.mode("errorifexists")
        .options(header="true", encoding="UTF-8", escape='"', emptyValue='""', nullValue="")
        .csv(path)
    )
