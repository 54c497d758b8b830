"""Connected components of a graph held as a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._common import discard, fresh_path, saved, scratch


def _mins(pairs: DataFrame) -> DataFrame:
    """The least neighbour of each node u, itself included; partial minima come before the shuffle.

    They are written, so that the join with the pairs has a shuffle of its own on either side:
    adaptive execution splits a hub's pairs only then.
    """
    return saved(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


def _down(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small(links: DataFrame) -> DataFrame:
    down = _down(links)
    least = _mins(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with a link: root is the component's least node.

    links: columns u, v (long, not null), in any direction, repeats and loops allowed; an empty
    table gives an empty table. Each round shuffles rows of two numbers, at most as many as there
    are links, and is written to the shared folder; more than `rounds` of them raise RuntimeError
    (they grow with the logarithm of the longest chain). The hub of a large star sits on one side of a
    join, which adaptive execution splits, and is summed up by partial minima elsewhere.
    """
    spark = links.sparkSession

    def written(make: Callable[[DataFrame], DataFrame], of: DataFrame) -> tuple[DataFrame, str, tuple]:
        """The links made, saved, where, and their number and a sum of hashes, observed while they are written."""
        seen, path = Observation(), fresh_path(spark, "links", keep=True)
        sign = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        with scratch(spark):
            return saved(make(of).distinct().observe(seen, *sign), "links", path), path, tuple(seen.get.items())

    now, path, sign = written(_down, links.where("u != v"))
    for _ in range(rounds):
        half, half_path, half_sign = written(_large, now)
        discard(spark, path)
        last = sign
        now, path, sign = written(_small, half)
        discard(spark, half_path)
        if last == half_sign == sign:  # neither step finds anything to do: stars, each around its least node
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    discard(spark, path)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
