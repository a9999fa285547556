"""How filters interact: what each removes alone, after others and in every order, from sorted posting lists."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import WORD, stage

#: Needles that are looked up together while galloping.
RUN = 256
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["size", "fails", "covered", "removed", "good_lost", "toxic_lost"]


def places(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """For each needle the number of smaller elements of hay; both are sorted.

    It gallops: for a run of needles, steps that double from the last place find the window of hay that the run falls into, and only that
    window is searched. Stretches of hay without needles cost the logarithm of their length.
    """
    out, at, n = np.empty(len(needles), np.int64), 0, len(hay)
    for i in range(0, len(needles), RUN):
        run, step = needles[i : i + RUN], 1
        while at + step < n and hay[at + step] < run[0]:
            at, step = at + step, 2 * step
        end, step = at, 1
        while end < n and hay[end] < run[-1]:
            end, step = end + step, 2 * step
        out[i : i + RUN] = at + np.searchsorted(hay[at : end + 1], run)
    return out


def among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of a stand in b. The shorter list is looked up in the longer one."""
    if len(a) <= len(b):
        at = places(a, b)
        inside = at < len(b)
        inside[inside] = b[at[inside]] == a[inside]
        return inside
    at = places(b, a)
    at, b = at[at < len(a)], b[at < len(a)]
    inside = np.zeros(len(a), bool)
    inside[at[a[at] == b]] = True
    return inside


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The elements of two sorted lists, sorted: those of the shorter that the longer lacks are put into their places."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    new = short[~among(short, long)]
    return np.insert(long, places(new, long), new) if len(new) else long


def posting_lists(rows: DataFrame, lists: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """part, first_id, last_id, size and, for each of lists, the sorted numbers of the rows where that column is true: a row for each range of ids of a part.

    rows: part (string), id_col, row (a number of its own) and the boolean columns `lists` (null counts as false). Rows are put in order of
    part, id and row over all tasks, so that a part of any size spreads over them; a row's number is its place in that order, and grows
    from task to task. A range holds at most as many rows as an Arrow batch.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    keys = ["part", id_col, "row"]
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in lists]
    ordered = rows.select(*keys, *flags).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for pdf in batches:
            found = []
            for part, own in pdf.groupby("part", sort=False):
                ids = own[id_col]
                hits = [number + np.flatnonzero(own[c].to_numpy(bool)) for c in lists]
                found.append((part, ids.iat[0], ids.iat[-1], len(own), *hits))
                number += len(own)
            out = pd.DataFrame(found, columns=["part", "first_id", "last_id", "size", *lists])
            if kind in ("bigint", "int"):  # a null id makes pandas read floats
                out[["first_id", "last_id"]] = out[["first_id", "last_id"]].astype("Int64")
            yield out

    arrays = ", ".join(f"`{c}` array<long>" for c in lists)
    return ordered.mapInPandas(run, f"part string, first_id {kind}, last_id {kind}, size long, {arrays}")


def _lattice(lists: Sequence[str], filters: Sequence[str], good: str, toxic: str):
    """For mapInPandas over posting lists: the counts of each filter after each set of other filters (a bit mask)."""
    n = len(filters)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            sums: dict[tuple, np.ndarray] = {}
            for row in pdf.itertuples(index=False):
                own = {c: np.asarray(getattr(row, c), np.int64) for c in lists}
                unions = {0: np.zeros(0, np.int64)}
                for mask in range(1, 1 << n):
                    low = (mask & -mask).bit_length() - 1
                    unions[mask] = union(unions[mask & (mask - 1)], own[filters[low]])
                for f, name in enumerate(filters):
                    for mask in (m for m in range(1 << n) if not m >> f & 1):
                        removed = own[name][~among(own[name], unions[mask])]
                        counts = (row.size, len(own[name]), len(unions[mask]), len(removed), among(removed, own[good]).sum(), among(removed, own[toxic]).sum())
                        key = (row.part, f, mask)
                        sums[key] = sums.get(key, 0) + np.array(counts, np.int64)
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["part", "filter", "mask", *COUNTS])

    return run


def audit(lists: DataFrame, filters: Sequence[str], orders: Sequence[str] | None = None, good: str = "good", toxic: str = "toxic") -> DataFrame:
    """part, filter_order, step and long counts: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    lists: posting_lists() of one-letter filters and of the marks good and toxic. Each range of ids gives, for every filter and every set of
    other filters, the sizes of unions and differences of its lists; sums over ranges then serve all orders (default: all permutations),
    as what a filter removes depends on the set of those before it only. The lattice has k * 2^(k-1) entries and the default k! orders for k
    filters: meant for a handful. shapley is the filter's removed rows summed over the given orders. Every part of lists has
    all rows, zeros included; an empty table gives an empty result.
    """
    spark = lists.sparkSession
    names = [*filters, good, toxic]
    schema = "part string, filter int, mask int, " + ", ".join(f"{c} long" for c in COUNTS)
    sums = lists.mapInPandas(_lattice(names, list(filters), good, toxic), schema).groupBy("part", "filter", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))
    steps = []
    for order in orders or ["".join(p) for p in permutations(filters)]:
        mask = 0
        for k, letter in enumerate(order):
            f = list(filters).index(letter)
            steps.append((order, k + 1, f, mask))
            mask |= 1 << f
    times = Counter((f, m) for _, _, f, m in steps)
    table = spark.createDataFrame([(*s, times[s[2:]]) for s in steps], "filter_order string, step int, filter int, mask int, times int")
    others = F.lit((1 << len(filters)) - 1) - F.expr("shiftleft(1, filter)")
    own = Window.partitionBy("part", "filter")
    weights = table.select("filter", "mask", "times").distinct()
    whole = sums.join(F.broadcast(weights), ["filter", "mask"], "left")  # an entry for each of k * 2^(k-1) sets
    whole = whole.withColumns({"unique_fails": F.max(F.when(F.col("mask") == others, F.col("removed"))).over(own), "shapley": F.sum(F.col("removed") * F.coalesce("times", F.lit(0))).over(own)})
    out = whole.drop("times").join(F.broadcast(table.drop("times")), ["filter", "mask"])
    return out.select(
        "part", "filter_order", "step", (F.col("size") - F.col("covered") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley"),
    )


def text_failures(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """part, doc_id, row, A .. E, good, toxic of every row of docs: which of five filters its whole text fails (null: empty).

    A: under 100 words. B: 100 * distinct words < 80 * words, case told apart. C: 100 * letters A-Z > 10 * code points. D: holds one of #$%&*|.
    E: its text is that of a row with a smaller id, whichever part that is in; rows that share text and id don't fail for each other,
    and a null id fails none. good, toxic: a row of labels with that id says quality 1, toxic 1. The first id of each text comes
    from a grouped minimum, and rows look it up by text and id, so that a text of any number of copies is spread.
    part defaults to lang; null is the empty string.
    """
    part = F.coalesce((F.col("lang") if part is None else part).cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    read = docs.select(part.alias("part"), "doc_id", text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, t = F.size("words"), F.col("text")
    upper = F.length(t) - F.length(F.translate(t, UPPER, ""))
    tests = {"A": n < 100, "B": 100 * F.size(F.array_distinct("words")) < 80 * n, "C": 100 * upper > 10 * F.length(t), "D": t.rlike(r"[#$%&*|]")}
    judged = stage(read.select("part", "doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(t, 256)).alias("digest"), *(c.alias(k) for k, c in tests.items())))
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = judged.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    return rows.select("part", "doc_id", "row", *tests, (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("E"), "good", "toxic")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters in all 120 orders, for each lang."""
    rows = text_failures(docs, labels)
    return audit(posting_lists(rows, [*"ABCDE", "good", "toxic"]), "ABCDE")
