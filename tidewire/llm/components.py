"""Connected components of a link table by contraction, without gathering any component in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import stage


def _to_roots(parent: DataFrame) -> DataFrame:
    """Follows node -> up until the end of each chain, doubling the step each time."""
    while True:
        up = parent.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        step = stage(parent.join(up, parent["up"] == up["mid"], "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        parent = step.select("node", "up")
        if step.where("moved").isEmpty():
            return parent


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node with a link to another one.

    Each round points every node at its smallest smaller neighbour, follows the pointers to the roots, renames the
    links by the roots and drops those within a root. The links that are left shrink each round, whatever the size
    of a component; a node with very many links is only ever reduced by min() or joined, never collected.
    Null ends and links of a node to itself are left out. An empty table gives an empty result.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = stage(pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        roots = _to_roots(pairs.groupBy("hi").agg(F.min("lo").alias("up")).select(F.col("hi").alias("node"), "up"))
        rounds.append(roots)
        hi = roots.select(F.col("node").alias("hi"), F.col("up").alias("hi_root"))
        lo = roots.select(F.col("node").alias("lo"), F.col("up").alias("lo_root"))
        renamed = pairs.join(hi, "hi").join(lo, "lo", "left").select(F.col("hi_root").alias("x"), F.coalesce("lo_root", "lo").alias("y"))
        pairs = stage(renamed.where("x != y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        onward = later.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        moved = earlier.join(onward, earlier["up"] == onward["mid"], "left").select("node", F.coalesce("top", "up").alias("up"))
        return moved.unionByName(later)

    if not rounds:
        return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    every = reduce(compose, reversed(rounds))
    tops = every.select(F.col("up").alias("node")).distinct().withColumn("up", F.col("node"))
    return every.unionByName(tops).select("node", F.col("up").alias("component"))
