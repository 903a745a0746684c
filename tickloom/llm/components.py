"""Connected components of links between 64-bit ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import scratch_table


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` links to ``(id, root)``, one row for each id that has a link; root is the smallest id of its component.

    Large-star and small-star steps in turn, until the links no longer change. Each step takes the smallest
    neighbour of an id by a partial aggregate, so an id with very many links costs a task no more than one row;
    the join that follows is an ordinary sort-merge join whose large partitions Spark splits.
    Links are written to the shared folder between rounds. Null ids have no links; no links give no rows.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = scratch_table(links)
    before = None
    while (now := _digest(links)) != before:
        before = now
        links = scratch_table(_small_star(_large_star(links)))
    return links.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of an id is linked to the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of an id, and the id itself, is linked to the smallest of them."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
