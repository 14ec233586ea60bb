"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.session import materialise

_LINKS_PER_TASK = 20_000


def _nearest(edges: DataFrame) -> DataFrame:
    """Each u of (u, v) with the smallest v, folded in the map tasks first."""
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash"),
    ).first()
    return row["n"], row["hash"]


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (u, v).

    The component is the smallest node reachable. Links with a null end and
    self-links are ignored; nodes without a link do not appear. Every step
    groups and joins links, so a node with very many links is one partial
    minimum per task and a join partition that adaptive execution splits. The
    number of rounds grows with the logarithm of the longest path; a search that
    has not settled by `most_rounds` raises instead of returning a part.
    """
    links = materialise(
        edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = _state(links)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        # Few links need few tasks; many keep the partitions they have.
        tasks = before[0] // _LINKS_PER_TASK + 1
        links = links.coalesce(tasks)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _nearest(both).select("u", F.least("u", "low").alias("low"))
        large = (
            both.join(low, "u")
            .filter("v > u AND v <> low")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .coalesce(tasks)
            .distinct()
        )
        low = _nearest(large)
        small = (
            large.join(low, "u")
            .filter("v <> low")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(low.withColumnRenamed("low", "v"))
            .filter("u <> v")
            .coalesce(tasks)
            .distinct()
        )
        links = materialise(small.coalesce(tasks))
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
