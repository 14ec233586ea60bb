"""What a comment is worth.

Joins to the episode table carry no hint: Spark broadcasts the table only when
its measured size allows, and otherwise sorts and merges, splitting the
partition of a hot episode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.dates import day_of

PREVIEW_PRICE = 1200
BASE_PRICE = 500


def preview_price(day: Column, upload: Column, price: int = PREVIEW_PRICE) -> Column:
    """Paid preview when the comment is older than the upload; 0 when unmatched."""
    return F.when(day < upload, F.lit(price)).otherwise(F.lit(0)).cast("long")


def priced_comments(
    comments: DataFrame,
    episodes: DataFrame,
    key: str = "episode",
    ts: str = "comment_date",
    like: str = "comment_like",
    upload: str = "upload_at",
    preview: int = PREVIEW_PRICE,
    base: int = BASE_PRICE,
) -> DataFrame:
    """Every comment with its preview value and total price.

    `episodes` holds one row per key. Comments without an episode stay and
    have no preview value.
    """
    joined = comments.join(episodes, key, "left")
    return joined.withColumn(
        "cookie", preview_price(day_of(F.col(ts)), F.col(upload), preview)
    ).withColumn("price", F.col("cookie") + F.col(like) + F.lit(base))
