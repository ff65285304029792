"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settled


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``u``, ``v``); root is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each step hangs the
    neighbours of a node under the smallest of them, until the links form stars.  Only links are
    shuffled, minima are combined before each shuffle, and each round is checkpointed.  Loops
    and repeated links change nothing, links with a null end are no links; no links give an empty table.
    """
    stars = settled(links.filter("u != v").select("u", "v").distinct())
    before = None
    while (now := _digest(stars)) != before:
        before = now
        stars = settled(_small_star(_large_star(stars)))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v"))).first()
    return tuple(row)


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node go under its smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = both.join(_least_neighbour(both), "u").filter("v > u")
    return hung.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go under the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    hung = down.join(least, "u").filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return hung.unionByName(least.select("u", F.col("least").alias("v"))).distinct()
