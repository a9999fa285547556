"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import WORD, salted_prefix, stage

#: Rounds of the permutations, and how often a place beyond the end is sent on at most: as often as there can be such places up to
#: 4096 indices, and with more of them none needs a part of that.
ROUNDS, WALKS = 4, 64

#: Slots that a task should make; their number follows the mix.
TASK_SLOTS = 1 << 18


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(rows: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, idx (0.. by code point, null last), weight, source_size, target, from rows (source, size): a row a source.

    share of all sizes is dealt to the sources by weight; a source stops at `most` times its size and what it leaves goes
    to the others by weight, until none is above. That is the level L with sum(min(weight * L, cap)) = total: sources are
    passed by cap / weight, and L is what is left over the weights that are left, at the first that it doesn't fill.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sizes.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("idx") % len(cycle) + 1).cast("int")).cast("double")
    caps = ordered.withColumns({"weight": weight, "cap": F.col("source_size").cast("double") * most})
    every = Window.partitionBy()
    on = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    before = F.coalesce(F.sum("cap").over(on.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(on.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every).cast("double") * share - before) / after
    levels = caps.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    water = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return levels.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * water)).select("source", "idx", "weight", "source_size", "target")


def permuted(k: Column, n: Column, *salt: Column) -> Column:
    """The place of index k in a pseudorandom permutation of 0 .. n - 1 that salt names.

    Indices are places in a grid of about sqrt(n) rows; in turn the row moves by a hash of the column and the column by one of the row.
    A place beyond n - 1 is sent on through the same steps until it lies below n, which keeps the map one to one.
    """
    high = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    wide = F.ceil(n / high).cast("long")

    def once(x: Column) -> Column:
        row, column = F.floor(x / wide).cast("long"), x % wide
        for r in range(ROUNDS):
            if r % 2 == 0:
                row = F.pmod(row + F.pmod(F.xxhash64(F.lit(r), column, *salt), high), high)
            else:
                column = F.pmod(column + F.pmod(F.xxhash64(F.lit(r), row, *salt), wide), wide)
        return row * wide + column

    first = once(k)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(walked)


def _holding(points: DataFrame, value: str, intervals: DataFrame, total: int, count: int) -> DataFrame:
    """points with the columns of the interval [lo, hi) that holds `value`: intervals follow each other over 0 .. total.

    Both are joined by bins of the mean interval's width, so an interval stands in as many bins as it covers, and all of them together in at most two each.
    """
    width = max(1, total // max(1, count))
    binned = intervals.where("hi > lo").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    found = points.withColumn("__bin", F.floor(F.col(value) / width)).join(binned, "__bin")
    return found.where((F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))).drop("__bin", "lo", "hi")


def draws(sources: DataFrame, total: int, count: int, shard_slots: int, seed: int) -> DataFrame:
    """idx, block, shard for every slot of the mix, from `count` sources (idx, blocks, quota; quotas add up to total).

    Each output shard of shard_slots slots draws a source for each slot, with the sources' quotas of blocks as chances:
    multinomial counts. Where the shards so far have drawn a source's whole quota, further draws of it are
    moved to the sources that stay short, in order, so that the totals are the quotas. The k-th slot of a source, over all
    shards, takes the block at k mod n of a permutation of its n blocks that depends on k div n.
    """
    spark = sources.sparkSession
    running = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)  # a row a source
    spans = sources.withColumn("hi", F.sum("quota").over(running)).withColumn("lo", F.col("hi") - F.col("quota"))
    drawn = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("drawn"))
    counts = _holding(drawn, "drawn", spans.select("idx", "quota", "lo", "hi"), total, count).groupBy("shard", "idx").agg(F.count(F.lit(1)).alias("n"), F.first("quota").alias("quota"))
    by_shard = Window.partitionBy("idx").orderBy("shard")
    prior = F.coalesce(F.sum("n").over(by_shard.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = stage(counts.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - prior)).cast("long")))

    got = kept.groupBy("idx").agg(F.sum("kept").alias("got"))
    lack = sources.join(got, "idx", "left").select("idx", (F.col("quota") - F.coalesce("got", F.lit(0))).alias("lack"))
    short = lack.withColumn("hi", F.sum("lack").over(running)).select("idx", (F.col("hi") - F.col("lack")).alias("lo"), "hi")
    over = kept.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("over"))
    end = F.sum("over").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))  # a row a shard
    over = over.withColumn("end", end).where("over > 0").withColumn("p", F.explode(F.sequence(F.col("end") - F.col("over"), F.col("end") - 1)))
    moved_total = kept.agg(F.sum(F.col("n") - F.col("kept"))).first()[0] or 0
    moved = _holding(over.select("shard", "p"), "p", short, moved_total, count).groupBy("shard", "idx").agg(F.count(F.lit(1)).alias("kept"))
    final = kept.select("shard", "idx", "kept").unionByName(moved).groupBy("shard", "idx").agg(F.sum("kept").alias("n")).where("n > 0")
    first = F.sum("n").over(by_shard.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    # Runs are dealt by shard and source before they become slots, so that no source's slots are made in one task.
    runs = final.withColumn("first", first).join(sources.select("idx", "blocks"), "idx").repartition(-(-total // TASK_SLOTS), "shard", "idx")
    slots = runs.select("shard", "idx", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))
    return slots.select("shard", "idx", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("idx"), F.floor(F.col("k") / F.col("blocks"))).alias("block"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block_words: int = 128, shard_slots: int = 1 << 14, seed: int = 7, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(parts, sizes) of docs (doc_id, text, source and __row, a number of each row's own). parts: __row, doc_id, source, first (its place in its
    source), size, from, words, times, source_size, target: for each run of words of a document
    that lies in one block, how often the mix takes it. sizes: __row, doc_id, source, size, source_size, target of every row.

    A source's documents, in an order by a hash of their ids, are one stream of words, cut into blocks of block_words (the last
    may be shorter). A source has quota = target / mean block words slots, at most `most` for each block, so no run is
    taken more often than that. Everything follows from the rows and seed, so reruns agree.
    A null text has size 0; a null source is a source of its own; rows without words are never drawn; rows that repeat, or share an id, are rows of
    their own. An empty table gives empty results. Of the sources, only their number and the sum of their quotas come to the driver.
    """
    spark = docs.sparkSession
    sized = stage(docs.select("__row", "doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.when(blocks > 0, F.least(most * blocks, F.round(F.col("target") * blocks / F.col("source_size")).cast("long"))).otherwise(F.lit(0).cast("long"))
    weighed = stage(targets(sized, cycle, share, most).withColumns({"blocks": F.greatest(blocks, F.lit(1).cast("long")), "quota": quota}))
    total, count = weighed.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    used = draws(weighed, total, count, shard_slots, seed).groupBy("idx", "block").agg(F.count(F.lit(1)).alias("times")) if total else spark.createDataFrame([], "idx int, block long, times long")

    named = weighed.select(F.col("source").alias("__source"), "idx", "source_size", "target")
    sizes = sized.join(named, sized["source"].eqNullSafe(named["__source"])).drop("__source")
    placed = salted_prefix(sizes.where("size > 0"), ["idx"], [F.col("doc_id"), F.col("size"), F.col("tie")], F.col("size"), salts, "first")
    first, size = F.col("first"), F.col("size")
    spread = placed.withColumn("block", F.explode(F.sequence(F.floor(first / block_words), F.floor((first + size - 1) / block_words))))
    start = F.greatest(first, F.col("block") * block_words)
    stop = F.least(first + size, (F.col("block") + 1) * block_words)
    parts = spread.select("__row", "doc_id", "source", "idx", "first", "size", "source_size", "target", "block", (start - first).alias("from"), (stop - start).alias("words"))
    # Sizes estimated through explode() are far too small, so the join says itself that neither side is to be broadcast.
    return parts.join(used.hint("merge"), ["idx", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0))).drop("idx", "block"), sizes.drop("idx", "tie")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs: how many of its words the mix takes, repeats counted."""
    parts, sizes = mix(docs.select("doc_id", "text", "source").withColumn("__row", F.monotonically_increasing_id()), **options)
    keys = ["__row", "doc_id", "size", "source_size", "target"]
    taken = parts.groupBy(*keys).agg(F.sum(F.col("words") * F.col("times")).cast("long").alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(*columns).unionByName(sizes.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns))


def mixed_documents(docs: DataFrame, most: int = 2, block_words: int = 128, **options) -> DataFrame:
    """The mix as documents, with the columns of docs: for each time that words of a document are taken, a row with those words.

    A row that takes all words keeps its text as it is; else the words are joined by one space. Rows are told by a number of their own,
    so ids may repeat or be null; documents that the mix doesn't take are left out.
    """
    kept = stage(docs.withColumn("__row", F.monotonically_increasing_id()))
    parts, _ = mix(kept, most=most, block_words=block_words, **options)
    runs = F.transform(F.array_sort(F.collect_list(F.struct("from", "times"))), lambda r: r["times"])
    taken = parts.groupBy("__row").agg(runs.alias("__times"), F.max(F.col("first") % block_words).alias("__in_block")).where(F.array_max("__times") > 0)
    rows = kept.join(taken.hint("merge"), "__row").withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("__times"))))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    run = lambda i: (F.floor((F.col("__in_block") + i) / block_words) + 1).cast("int")
    cut = F.array_join(F.filter(words, lambda w, i: F.element_at("__times", run(i)) >= F.col("__turn")), " ")
    text = F.when(F.array_min("__times") >= F.col("__turn"), F.col("text")).otherwise(cut)
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
