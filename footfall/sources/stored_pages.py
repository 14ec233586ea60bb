"""Rows out of stored web pages, with regular expressions that Spark runs itself."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.dates import as_day


def block_records(
    pages: DataFrame,
    block: str,
    patterns: Mapping[str, str],
    keys: list[str],
    page_patterns: Mapping[str, str] | None = None,
    html: str = "html",
    required: tuple[str, ...] = (),
    integer_fields: tuple[str, ...] = (),
    position: str = "position",
) -> DataFrame:
    """One row per record block of each page, with page-level fields beside.

    `block` matches one whole record; its fields are looked for inside it, so a
    record never takes a field of another. A field that is absent is NULL; a
    record is dropped whole when a required field is absent or an integer field
    does not parse.
    """
    page_patterns = page_patterns or {}
    found = pages.select(
        *keys,
        *[
            F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")).alias(name)
            for name, pattern in page_patterns.items()
        ],
        F.posexplode(F.regexp_extract_all(html, F.lit(block), F.lit(0))).alias(position, "_block"),
    )
    fields = []
    for name, pattern in patterns.items():
        text = F.nullif(F.regexp_extract("_block", pattern, 1), F.lit(""))
        fields.append((F.trim(text).try_cast("int") if name in integer_fields else text).alias(name))
    rows = found.select(*keys, *page_patterns, position, *fields)
    needed = [*required, *integer_fields]
    return rows.dropna(subset=needed) if needed else rows


def repeated_records(
    pages: DataFrame,
    patterns: Mapping[str, str],
    keys: list[str],
    html: str = "html",
    integer_fields: tuple[str, ...] = (),
    position: str = "position",
) -> DataFrame:
    """Parallel field lists of each page, paired by place; the shortest list ends them.

    Every field has a pattern with one group over the whole page. A record is
    dropped whole when one of its integer fields does not parse. A page whose
    records lack fields pairs them wrongly: use `block_records` there.
    """
    fields = list(patterns)
    found = pages.select(
        *keys,
        *[
            F.regexp_extract_all(html, F.lit(patterns[name]), F.lit(1)).alias(name)
            for name in fields
        ],
    )
    sizes = [F.size(name) for name in fields]
    shortest = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    zipped = F.arrays_zip(*[F.slice(F.col(name), F.lit(1), shortest).alias(name) for name in fields])
    rows = found.select(*keys, F.posexplode(zipped).alias(position, "_record")).select(
        *keys,
        F.col(position),
        *[_field(name, name in integer_fields) for name in fields],
    )
    return rows.dropna(subset=list(integer_fields)) if integer_fields else rows


def _field(name: str, integer: bool) -> Column:
    text = F.col("_record").getField(name)
    return (F.trim(text).try_cast("int") if integer else text).alias(name)


def page_fields(
    pages: DataFrame,
    patterns: Mapping[str, str],
    keys: list[str],
    run_day,
    html: str = "html",
    digit_fields: tuple[str, ...] = (),
) -> DataFrame:
    """One row per page: the first match of each pattern, stamped with the run day.

    `digit_fields` keep only their digits. The run day is an argument, so a
    repeated run gives the same table.
    """
    columns = []
    for name, pattern in patterns.items():
        text = F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
        if name in digit_fields:
            text = F.regexp_replace(text, r"[^0-9]", "").try_cast("int")
        columns.append(text.alias(name))
    return pages.select(*keys, *columns, as_day(run_day).alias("down_at"))


def record_counts(records: DataFrame, keys: list[str]) -> DataFrame:
    """How many records each page gave."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))
