"""Comparing the rows of a group with each other, in tiles, whatever the group's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import whole_groups


def tile_pairs(rows: DataFrame, group: list[str], node: str, tile_rows: int) -> DataFrame:
    """Deals each group of two or more rows into tiles of about tile_rows rows by a hash of `node`, and repeats each row once for
    every pair of tiles that its tile is in. Adds tile_a <= tile_b (the pair) and in_a (the row is of tile_a).

    A group of n rows becomes (n / tile_rows)^2 / 2 pairs of tiles, each a task's worth of bounded size, so that no
    group is ever gathered whole. Rows of one group only meet within pairs of tiles.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    sizes = sizes.select(*group, F.ceil(F.col("__n") / tile_rows).cast("int").alias("__tiles"))
    dealt = rows.join(sizes, group).withColumn("__tile", F.pmod(F.xxhash64(node), F.col("__tiles")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
    return dealt.select("*", F.least("__tile", "__other").alias("tile_a"), F.greatest("__tile", "__other").alias("tile_b"), (F.col("__tile") <= F.col("__other")).alias("in_a")).drop("__tiles", "__tile", "__other")


def per_pair(pairs: DataFrame, group: list[str], kernel, schema: str) -> DataFrame:
    """Runs kernel over frames that hold whole pairs of tiles, sorted by group and pair."""
    keys = [*group, "tile_a", "tile_b"]
    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(whole_groups(kernel, keys), schema)
