"""Episode title text helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_number(text: Column, strict: bool = True) -> Column:
    """First number with no letter or digit before it and a non-digit after it.

    The look-behind spells out a Unicode word boundary, whose meaning for
    non-Latin letters differs between Java versions. Strict mode fails the job
    when a text has no such number; otherwise it is NULL.
    """
    found = F.regexp_extract(text, r"(?<![\p{L}\p{N}_])(\d+)\D", 1)
    return found.cast("int") if strict else found.try_cast("int")


def strip_whitespace(text: Column) -> Column:
    """Trim every kind of white space; Spark's `trim` only drops spaces."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def series_title(
    episode: Column,
    chapter: Column | None = None,
    short_titles: Mapping[int, int] | None = None,
) -> Column:
    """Text after the first colon without its trailing part number.

    NULL when there is no colon. `short_titles` maps single chapters to the
    number of characters kept of their title.
    """
    part = F.get(F.split(episode, ":"), F.lit(1))
    title = strip_whitespace(F.regexp_replace(part, r"\s*\(\d+\)$", ""))
    for number, length in (short_titles or {}).items():
        title = F.when(chapter == number, F.substring(title, 1, length)).otherwise(title)
    return title


def link(template: str, *keys: Column) -> Column:
    """Build an address from key columns; `template` uses printf marks."""
    return F.format_string(template, *keys)
