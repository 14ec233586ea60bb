"""Exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.tokens import default_path, encoder


def encoded_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: its number of token ids (null or empty text: 0)."""
    path = path or default_path()

    def count(batches):
        encode = encoder(path).encode
        for batch in batches:
            sizes = [len(encode(x)) // 4 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["length"])

    return docs.select("text").mapInArrow(count, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Documents per length, with running and suffix sums.

    For each length L that occurs, ascending: `documents` of that length;
    `documents_at_most` and `documents_at_least`; `tokens_at_least`, the tokens of
    documents of at least L; `tokens_within`, the total when every document is cut
    to L tokens; `tokens_total`. Lengths are counted before the shuffle, so the
    window sees one row per distinct length, at most the longest document's
    number of tokens.
    """
    counted = lengths.filter("length IS NOT NULL").groupBy("length").agg(
        F.count(F.lit(1)).alias("documents")
    )
    up = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("length").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    tokens = F.col("length") * F.col("documents")
    return (
        counted.select(
            "length",
            "documents",
            F.sum("documents").over(up).alias("documents_at_most"),
            F.sum("documents").over(every).alias("all_documents"),
            F.sum(tokens).over(up).alias("tokens_at_most"),
            F.sum(tokens).over(every).alias("tokens_total"),
        )
        .withColumn(
            "documents_at_least",
            F.col("all_documents") - F.col("documents_at_most") + F.col("documents"),
        )
        .withColumn(
            "tokens_at_least",
            F.col("tokens_total") - F.col("tokens_at_most") + F.col("length") * F.col("documents"),
        )
        .withColumn(
            "tokens_within",
            F.col("tokens_at_most")
            + F.col("length") * (F.col("all_documents") - F.col("documents_at_most")),
        )
        .select(
            "length", "documents", "documents_at_most", "documents_at_least",
            "tokens_at_least", "tokens_within", "tokens_total",
        )
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to `limit`; 0 for an empty table."""
    row = histogram.agg(
        F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("documents")).alias("total")
    ).first()
    return row["total"] or 0


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """Smallest length that at least `share` of the documents do not exceed.

    Null for an empty table; a share of 0 gives the smallest length.
    """
    if not 0.0 <= share <= 1.0:
        raise ValueError("share must lie between 0 and 1")
    reached: Column = F.col("documents_at_most") >= F.lit(share) * (
        F.col("documents_at_most") + F.col("documents_at_least") - F.col("documents")
    )
    return histogram.filter(reached).agg(F.min("length").alias("length")).first()["length"]


def token_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Histogram of whole documents.

    Only `text` is read; other columns are ignored. Null and empty texts count
    with length 0, repeated rows each count, and an empty table gives no rows.
    """
    return length_histogram(encoded_lengths(docs, path))
