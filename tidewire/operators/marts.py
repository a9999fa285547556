"""Reporting tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_trend(log: DataFrame, days: int = 30) -> DataFrame:
    """day, judged, passed, sent of the last days."""
    by = log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return by.agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("score") >= 50).alias("passed"), F.count_if(F.col("score") >= 65).alias("sent")).orderBy(F.col("day").desc()).limit(days)


def drop_reasons(rows: DataFrame, last: int = 600, top: int = 12, width: int = 40) -> DataFrame:
    """The commonest reasons among the last drops, by their first characters."""
    recent = rows.orderBy(F.col("ts").desc(), F.col("key").desc()).limit(last)
    return recent.groupBy(F.substring("reason", 1, width).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason").limit(top)


def frequencies(rows: DataFrame, array: str, name: str, top: int) -> DataFrame:
    """The most frequent elements of an array column."""
    return rows.select(F.explode(array).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), name).limit(top)


def editions(rows: DataFrame) -> DataFrame:
    """edition, n, sorted distinct topics, the sum of the keys. The items themselves stay rows: see edition_items."""
    return rows.groupBy("edition").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("action")).alias("topics"), F.sum("key").alias("keys"))


def edition_items(rows: DataFrame, topics: list[str]) -> DataFrame:
    """rows of editions with their place: by topic in the given order (others last), then by original time, rows without one first."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, topics)), F.col("action")), F.lit(0)), F.lit(len(topics) + 1))
    by = Window.partitionBy("edition").orderBy(order, F.coalesce(F.unix_timestamp("ts"), F.lit(0)), "key")
    return rows.withColumn("place", F.row_number().over(by))


def kpis(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("judged"),
        F.count_if(F.col("score") >= 65).alias("sent"),
        F.count_if((F.col("score") >= 85) & (F.col("action") == "deal")).alias("key_issues"),
        F.countDistinct("cluster").alias("clusters"),
        F.unix_timestamp(F.max("ts")).alias("last"),
    )


def health(last: Column, now: Column) -> Column:
    """ok within 2 hours, warn within 6, else down."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(last)) / 3600
    return F.when(age < 2, "ok").when(age < 6, "warn").otherwise("down")


def upper_median_gap(log: DataFrame, by: str, days: int = 1) -> DataFrame:
    """The median of the seconds between consecutive rows; of an even number the upper one. Equal gaps are counted before they are put in order.

    A key's rows are put in order by spans of days, and the first of a span takes the last time of the span before it, so that a key that
    holds most rows is spread over its spans.
    """
    at = F.unix_timestamp("ts")
    timed = log.select(by, "key", at.alias("at"), F.floor(at / (days * 86400)).alias("span"))
    spans = timed.groupBy(by, "span").agg(F.max("at").alias("last"))
    before = spans.select(F.col(by).alias("__by"), F.col("span").alias("__span"), F.lag("last").over(Window.partitionBy(by).orderBy("span")).alias("before"))
    inside = timed.withColumn("prior", F.lag("at").over(Window.partitionBy(by, "span").orderBy("at", "key")))
    joined = inside.join(before, inside[by].eqNullSafe(before["__by"]) & inside["span"].eqNullSafe(before["__span"]))
    gaps = joined.select(by, (F.col("at") - F.coalesce("prior", "before")).alias("gap")).where("gap IS NOT NULL")
    counts = gaps.groupBy(by, "gap").agg(F.count(F.lit(1)).alias("times"))
    upto = F.sum("times").over(Window.partitionBy(by).orderBy("gap").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.floor(F.sum("times").over(Window.partitionBy(by)) / 2) + 1
    placed = counts.withColumns({"upto": upto, "middle": middle})
    return placed.where((F.col("upto") >= F.col("middle")) & (F.col("upto") - F.col("times") < F.col("middle"))).select(by, "gap")


def evaluation(rows: DataFrame, by: str) -> DataFrame:
    """expected, judged and both, counted from two flags (null is false)."""
    e, j = F.coalesce("expected", F.lit(False)), F.coalesce("judged", F.lit(False))
    return rows.groupBy(by).agg(F.count_if(e).alias("expected"), F.count_if(j).alias("judged"), F.count_if(e & j).alias("hit"))


def deviation(rows: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """The distance between two distributions over a column, in percentage points."""
    share = lambda df, name: df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy())).select(by, name)
    both = share(rows, "s").join(share(truth, "t"), by, "full")
    return both.agg(F.round(F.sum(F.abs(F.coalesce("s", F.lit(0.0)) - F.coalesce("t", F.lit(0.0)))) * 100, 6).alias("points"))


def facet(sent: Column, duplicate: Column, passed: Column) -> Column:
    return F.when(sent, "sent").when(duplicate, "dup").when(passed, "passed").otherwise("dropped")


def volume(log: DataFrame, baseline: int, caught: Column) -> DataFrame:
    """Each day's rows against a baseline, and the share that a filter would catch."""
    by = log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(caught.cast("double")), 9).alias("share")).withColumn("over_baseline", F.col("n") - baseline)


def counts_with_zeros(rows: DataFrame, by: str, topics: list[str]) -> DataFrame:
    """A row for every topic, counted or not."""
    dim = rows.sparkSession.createDataFrame([(t,) for t in topics], f"{by} string")
    return dim.join(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def bulletin(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The lines of each edition as one text, in order."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda s: s["line"]), "\n").alias("text"))


def key_signals(picks: DataFrame, by: str, sentence: Column, most: int = 5) -> DataFrame:
    """The first sentences of an edition's key issues, the first `most` by place."""
    first = picks.where("key_issue").select(by, "place", sentence.alias("s")).withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy("place", "s"))).where(F.col("__rn") <= most)
    lines = F.array_sort(F.collect_list(F.struct("__rn", "s")))
    return first.groupBy(by).agg(F.transform(lines, lambda x: x["s"]).alias("signals"))


def counts_by(rows: DataFrame, columns: list[str], top: int | None = None, within: list[str] = ()) -> DataFrame:
    """within, facet, value, n: how often each value of each column comes, counted in one pass; with top the commonest of each."""
    faceted = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    counted = rows.select(*within, faceted.alias("f")).groupBy(*within, "f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counted
    place = F.row_number().over(Window.partitionBy(*within, "facet").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first()))
    return counted.withColumn("__place", place).where(F.col("__place") <= top).drop("__place")


def shown(rows: DataFrame, equal: dict[str, str] | None = None, holding: dict[str, str] | None = None, since: Column | None = None, words: str = "", fields: list[str] = (), ts: str = "ts") -> DataFrame:
    """The rows that a dashboard's filters leave: columns equal to a value, arrays that hold one, not older than since, words in one of the fields (case is ignored).

    Filters that are empty let all pass, so they compose to one condition that reaches the scan.
    """
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == v)
    for c, v in (holding or {}).items():
        rows = rows.where(F.array_contains(c, v))
    if since is not None:
        rows = rows.where(F.col(ts) >= since)
    if words:
        rows = rows.where(F.contains(F.lower(F.concat_ws("\n", *fields)), F.lit(words.lower())))
    return rows
