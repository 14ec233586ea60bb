"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import Workspace, word_count
from footfall.operators.ordering import in_slices

WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_copies: float = 3.0
) -> DataFrame:
    """Target of each source: `source, source_size, target`.

    Sources in code-point order, null last, take the weights in turn. The total of
    all sizes is shared by weight; a target stops at `most_copies` times its
    source's size and what is over is shared anew among the others. Sorted by
    size per weight, the capped sources come first, so one running sum finds
    the level at which the rest is shared. The windows run over one row per
    source, after sizes are summed.
    """
    held = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights) + 1)
    limit = F.lit(float(most_copies)) * F.col("source_size")
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = (
        held.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("level", level)
        .withColumn("place", F.row_number().over(fill))
        .withColumn("open", F.col("limit") > F.col("level") * F.col("weight"))
    )
    common = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(every)["level"]
    share = F.least(F.col("limit"), F.coalesce(common, F.lit(0.0)) * F.col("weight"))
    return ranked.select(
        "source",
        "source_size",
        F.when(F.col("source_size") > 0, F.when(common.isNull(), F.col("limit")).otherwise(share))
        .otherwise(F.lit(0.0))
        .alias("target"),
    )


def _offset(source, number: int):
    """A random offset in [0, 1) from a digest of the source's name."""
    name = F.concat(F.lit(f"mix:{number}:"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _with_offsets(placed: DataFrame, offsets: int) -> DataFrame:
    """(source, offset): of several random offsets the one that meets the target best."""
    last = F.col("before") + F.col("rows")

    def words(number: int):
        u = _offset(F.col("source"), number)
        copies = F.floor(F.col("expected") * last + u) - F.floor(
            F.col("expected") * F.col("before") + u
        )
        return F.sum(F.col("size") * copies)

    totals = placed.groupBy("source", "target").agg(
        *[words(k).alias(f"words_{k}") for k in range(offsets)]
    )
    tried = F.array(
        *[
            F.struct(
                F.abs(F.col(f"words_{k}") - F.col("target")).alias("miss"),
                F.lit(k).alias("number"),
                _offset(F.col("source"), k).alias("offset"),
            )
            for k in range(offsets)
        ]
    )
    return totals.select(
        F.col("source").alias("o_source"), F.array_min(tried)["offset"].alias("offset")
    )


def sampled(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most_copies: float = 3.0,
    offsets: int = 16,
) -> DataFrame:
    """Distinct documents with the range of copies their rows take.

    Returns `doc_id, text_hash, source, size, rows, before, source_size, target,
    expected, offset`. Every document of a source is expected `target /
    source_size` times; the running sum of that, in the order of (size, doc_id)
    within the source, plus one offset per source, emits a copy at each whole
    number crossed. Neighbours in that order are alike in size, so the words taken
    miss the target by less than the longest document, mostly by where the offset
    lies; of `offsets` random ones the one that misses least is used. Rows alike
    in all of these are one entry with a count.
    """
    work = Workspace(docs.sparkSession, "mixing")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.xxhash64("text").alias("text_hash"),
        word_count(F.col("text")).alias("size"),
    )
    grouped = work.stage(
        slim.groupBy("doc_id", "text_hash", "source", "size").agg(
            F.count(F.lit(1)).alias("rows")
        ),
        "documents",
    )
    targets = work.stage(
        source_targets(
            grouped.select("source", (F.col("size") * F.col("rows")).alias("size")),
            weights,
            most_copies,
        ),
        "targets",
    )
    # Slices are ranges of (source, size, doc_id), so a hot source spans many.
    sliced = in_slices(
        grouped.withColumn("no_source", F.col("source").isNull()),
        ["no_source", "source", "size", "doc_id", "text_hash"],
    )
    inside = (
        Window.partitionBy("_slice", "source")
        .orderBy("_place")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = (
        Window.partitionBy("source")
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    slices = (
        sliced.groupBy("source", "_slice")
        .agg(F.sum("rows").alias("held"))
        .select(
            F.col("source").alias("s_source"),
            F.col("_slice").alias("s_slice"),
            F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("skipped"),
        )
    )
    placed = sliced.withColumn("inside", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    placed = placed.join(
        slices, (F.col("s_slice") == F.col("_slice")) & F.col("s_source").eqNullSafe(F.col("source"))
    )
    named = targets.withColumnRenamed("source", "t_source")
    numbered = placed.join(named, F.col("t_source").eqNullSafe(F.col("source"))).select(
        "doc_id",
        "text_hash",
        "source",
        "size",
        "rows",
        (F.col("inside") + F.col("skipped")).alias("before"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(F.lit(0.0))
        .alias("expected"),
    )
    numbered = work.stage(numbered, "numbered")
    chosen = _with_offsets(numbered, offsets)
    return numbered.join(chosen, F.col("o_source").eqNullSafe(F.col("source"))).drop("o_source")


def copies_of(number) -> F.Column:
    """Copies of the row with this number, counted from 1 within its source."""
    here = F.floor(F.col("expected") * number + F.col("offset"))
    return here - F.floor(F.col("expected") * (number - 1) + F.col("offset"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most_copies: float = 3.0
) -> DataFrame:
    """Words each document gives: `doc_id, size, source_size, target, taken`.

    `docs` needs `doc_id`, `source` and `text`; other columns are ignored. Null
    texts are empty; a null source is a source of its own, listed last; a source
    without words has target 0. Repeated rows are sampled as separate documents.
    An empty table gives no rows. Offsets come from a digest of the source's name,
    so a rerun takes the same copies.
    """
    chosen = sampled(docs, weights, most_copies)
    each = chosen.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies_of(F.col("before") + F.col("k"))).cast("long").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most_copies: float = 3.0
) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it.

    Columns are those of `docs`. Documents without words are expected as often as
    others of their source.
    """
    chosen = sampled(docs, weights, most_copies).select(
        F.col("doc_id").alias("m_doc"), F.col("text_hash").alias("m_hash"),
        F.col("source").alias("m_source"), F.col("before").alias("m_before"), "expected", "offset",
    )
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        "source",
    )
    joined = marked.join(
        chosen,
        F.col("m_doc").eqNullSafe(F.col("doc_id"))
        & (F.col("m_hash") == F.col("text_hash"))
        & F.col("m_source").eqNullSafe(F.col("source")),
    )
    alike = Window.partitionBy("doc_id", "text_hash", "source").orderBy("m_before")
    counted = joined.withColumn("k", F.row_number().over(alike))
    return (
        counted.withColumn("copies", copies_of(F.col("m_before") + F.col("k")).cast("int"))
        .filter("copies > 0")
        .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
        .select("row.*")
    )
