"""Clusters of the same event: greedy leaders, chains of winners, representatives."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local one on a local master; on any other there must be one that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-rounds-"))
    return _OWN[0]


def stage_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes df to a new stage path and reads it back, so that its lineage ends there."""
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    STAGED[id(back)] = (weakref.ref(back), path)
    return back


STAGED: dict[int, tuple] = {}


def drop_staged(*tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads: all that follows from them has been written itself."""
    for df in tables:
        ref, path = STAGED.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done: it does so when the driver's JVM collects them, which a small driver
    heap full of nothing else puts off until the executors' disks hold every shuffle of a long operator."""
    gc.collect()
    spark._jvm.System.gc()


def first_leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, rank, leader of nodes (id, rank, unique): what a pass in rank order keeps, dropping rows like a kept one.

    edges (a, b) join like rows, in either direction. This is the lexicographically first maximal independent set, found in rounds: a
    row that outranks all its undecided neighbours is kept and its neighbours are dropped. A dropped row's leader is
    its kept neighbour of least rank.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    ranks = nodes.select(F.col("id"), "rank")
    links = both.join(ranks.withColumnsRenamed({"id": "a", "rank": "ra"}), "a").join(ranks.withColumnsRenamed({"id": "b", "rank": "rb"}), "b")
    links = staged(links)
    open_, kept = links, None
    while not open_.isEmpty():
        best = open_.groupBy("a").agg(F.min("rb").alias("other"), F.first("ra").alias("ra")).where("ra < other").select(F.col("a").alias("id"))
        best = staged(best)
        kept = best if kept is None else kept.unionByName(best)
        gone = open_.join(best, open_["a"] == best["id"], "left_semi").select(F.col("b").alias("id")).unionByName(best).distinct()
        left = open_.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        rest = staged(left.select("a", "b", "ra", "rb"))
        # Rows whose neighbours are all gone, and which aren't gone themselves, are kept too.
        alone = open_.select(F.col("a").alias("id")).distinct().join(gone, "id", "left_anti").join(rest.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
        kept = staged(kept.unionByName(alone))
        open_ = rest
    if kept is None:
        return nodes.select("id", "rank", F.col("id").alias("leader"))
    lead = links.join(kept.withColumnRenamed("id", "b"), "b", "left_semi").groupBy(F.col("a").alias("id")).agg(F.min_by("b", "rb").alias("leader"))
    dropped = lead.join(kept, "id", "left_anti")
    return nodes.join(dropped, "id", "left").select("id", "rank", F.coalesce("leader", "id").alias("leader"))


def blocked_leaders(rows: DataFrame, keys: list[str], rule: Callable[[Column, Column], Column], scope: tuple[str, ...] = (), facts: list[str] | None = None) -> DataFrame:
    """id, leader of rows (id, rank, scope, the array columns keys): first_leaders() where like rows share an element of keys, without a table of edges.

    rule(a, b): whether row a is like b, which ranks before it, by the columns facts (all, if not given); rows of different scopes aren't. Rounds over
    (block, row): a row that comes first in all its blocks is kept, and only rows that share a block with a kept one are compared with it. A word that
    most rows hold costs a row for each of them, not one for each pair. A row's leader is the least of all kept rows that are like it.
    Rounds carry numbers only, and what a round has written or shuffled is deleted once the next one stands.
    """
    spark = rows.sparkSession
    number = F.monotonically_increasing_id()
    mine = lambda k: F.transform(k, lambda x: F.xxhash64(*scope, F.lit(k), x))
    told = F.struct(*dict.fromkeys([*scope, *(facts or rows.columns)])).alias("row")
    held = staged(rows.select("id", "rank", told, F.array_distinct(F.concat(*map(mine, keys))).alias("blocks")))
    # Numbers follow the ranks, which are unique within a scope.
    ranked = staged(held.sort("rank").select(number.alias("__n"), "id", "row", "blocks"))
    each = ranked.select("__n", F.explode("blocks").alias("block"))
    shared = each.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block")
    every = staged(each.hint("merge").join(shared, "block", "left_semi"))
    sizes = staged(every.groupBy("__n").agg(F.count(F.lit(1)).alias("in")))
    drop_staged(held)
    release(spark)

    def like(met: DataFrame, leaders: DataFrame) -> DataFrame:
        """__n, __l: rows of met with the leaders that they are like."""
        seen = every.join(leaders, "__n", "left_semi").select("block", F.col("__n").alias("__l"))
        pairs = met.join(seen, "block").where("__l < __n").select("__n", "__l").distinct()
        b = ranked.join(leaders, "__n", "left_semi").select(F.col("__n").alias("__l"), F.col("row").alias("b"))
        both = pairs.join(b, "__l").join(ranked.select("__n", F.col("row").alias("a")), "__n")
        for c in scope:
            both = both.where(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")))
        return both.where(rule(F.col("a"), F.col("b"))).select("__n", "__l")

    open_, parts = every, []
    while not open_.isEmpty():
        first = open_.groupBy("block").agg(F.min("__n").alias("__n")).groupBy("__n").agg(F.count(F.lit(1)).alias("n"))
        new = staged(first.join(sizes, "__n").where("n = in").select("__n"))
        out = staged(like(open_, new).select("__n").distinct().unionByName(new))
        rest = staged(open_.join(out, "__n", "left_anti"))
        drop_staged(out, *([open_] if parts else []))
        parts.append(new)
        open_ = rest
        release(spark)
    if not parts:
        return ranked.select("id", F.col("id").alias("leader"))
    kept = staged(reduce(DataFrame.unionByName, parts))
    led = staged(like(every.join(kept, "__n", "left_anti"), kept).groupBy("__n").agg(F.min("__l").alias("__l")))
    release(spark)
    ids = ranked.select("__n", "id").join(led, "__n", "left").select("id", F.coalesce("__l", "__n").alias("__l"))
    found = staged(ids.join(ranked.select(F.col("__n").alias("__l"), F.col("id").alias("leader")), "__l").select("id", "leader"))
    drop_staged(open_, *parts, kept, led, sizes, every, ranked)
    release(spark)
    return found


def survivors(winners: DataFrame) -> DataFrame:
    """loser, survivor from winners (loser, winner): the end of each chain. Closed chains are left out."""
    ends = winners.select("loser", F.col("winner").alias("survivor"))
    for _ in range(40):
        on = ends.select(F.col("loser").alias("__l"), F.col("survivor").alias("__s"))
        step = staged(ends.join(on, ends["survivor"] == on["__l"], "left").select("loser", F.coalesce("__s", "survivor").alias("survivor"), F.col("__s").isNotNull().alias("moved")))
        ends = step.select("loser", "survivor")
        if step.where("moved").isEmpty():
            return ends
        if step.where("loser = survivor").count():
            ends = staged(ends.where("loser != survivor"))
    on = ends.select(F.col("loser").alias("survivor")).distinct()
    return ends.join(on, "survivor", "left_anti").select("loser", "survivor")


def best_of(rows: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def fingerprint(ents: Column, tokens: Column, action: Column, bucket: Column) -> Column:
    """names|action|bucket: the first two distinct names, or words where there are none."""
    names = F.when(F.size(ents) > 0, ents).otherwise(F.slice(F.array_sort(tokens), 1, 2))
    return F.concat_ws("|", F.array_join(F.slice(F.array_sort(F.array_distinct(names)), 1, 2), "+"), action, bucket.cast("string"))


def repeated_words(recent: DataFrame, published: DataFrame, words: str = "telling", times: int = 3, least: int = 4) -> DataFrame:
    """word: those of recent editions, and long ones that as many published items repeat."""
    often = published.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= times) & (F.length("word") >= least)).select("word")
    return recent.select(F.explode(words).alias("word")).union(often).distinct()


def blocked_by_story(rows: DataFrame, story: DataFrame, words: str = "telling", least: int = 4, few: int = 2) -> DataFrame:
    """key, reason words of rows that go on with a running story: one long word of it, or two of any length; facts pass."""
    each = rows.where("NOT material").select("key", F.explode(words).alias("word")).join(story, "word")
    found = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("word") >= least).alias("long"), F.array_sort(F.collect_set("word")).alias("words"))
    return found.where((F.col("long") >= 1) | (F.col("n") >= few)).select("key", F.array_join(F.slice("words", 1, 3), "·").alias("words"))
