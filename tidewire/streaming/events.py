"""The event index: clusters of one event across batches, each known by its best item so far."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewire.functions.text import NUMBER

_NUMBER = re.compile(NUMBER.replace(r"\p{L}", r"[^\W\d_]"))
#: What an item of the index tells; rank is compared as a whole, the greater one represents its cluster.
ITEM = "block string, key string, fp string, ts timestamp, tokens array<string>, ents array<string>, action string, bucket long, rank array<long>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rank(coverage: Column, source_weight: Column, body_length: Column, material: Column, score: Column, longest: int = 8000) -> Column:
    """How well an item represents its event: what it covers, its source, its length up to a limit, new facts, its score."""
    parts = (coverage, source_weight, F.least(body_length, F.lit(longest)), material.cast("int"), score)
    return F.array(*(F.coalesce(c.cast("long"), F.lit(0).cast("long")) for c in parts))


def likeness(generic: list[str], alone: float = 0.62, soft: float = 0.25) -> Callable[[dict, dict], tuple[float, bool]]:
    """The titles' Jaccard and whether two items at hand are one event: titles that agree, or pairs.same_event()."""

    def telling(words: set, names: set) -> set:
        kept = {w for w in words - set(generic) if len(w) >= 2 and not _NUMBER.match(w)}
        return {w for w in kept if not any(n and (w in n or n in w) for n in names)}

    def compare(a: dict, b: dict) -> tuple[float, bool]:
        x, y, names = set(a["tokens"]), set(b["tokens"]), {*a["ents"], *b["ents"]}
        jaccard = len(x & y) / len(x | y) if x and y else 0.0
        if jaccard >= alone:
            return jaccard, True
        if a["action"] != b["action"] or abs(a["bucket"] - b["bucket"]) > 1:
            return jaccard, False
        told = len(telling(x, names) & telling(y, names))
        shared = bool({*a["ents"]} & {*b["ents"]})
        return jaccard, (told >= 2 and jaccard >= soft) or (shared and (jaccard >= soft or told >= 1))

    return compare


class EventIndex(StatefulProcessor):
    """A block's clusters in map state, by the fingerprint of their first item; each keeps only its representative.

    An item joins the cluster of its own fingerprint, else, of the representatives that are one event with it, that of the most
    alike (the smallest name of equals); else it opens a cluster. It then stands for the cluster if its rank is greater than the
    representative's. Only representatives are compared, so clusters don't chain. Words lead to the representatives
    that hold them, so an item meets only those that share a word or a name. A cluster that no item joined for `days`
    is dropped by a timer once the watermark is past it, so the state of idle blocks goes.
    """

    def __init__(self, days: int, compare: Callable[[dict, dict], tuple[float, bool]]):
        self.days, self.compare = days, compare

    def init(self, handle) -> None:
        self.handle = handle
        value = "tokens array<string>, ents array<string>, action string, bucket bigint, rank array<bigint>, rep string, last bigint"
        self.clusters = handle.getMapState("clusters", "cluster string", value)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "key"], kind="stable")
        names = ("tokens", "ents", "action", "bucket", "rank", "rep", "last")
        known = {c[0]: dict(zip(names, v)) for c, v in self.clusters.iterator()}
        holders: dict[str, set] = {}

        def place(cluster: str) -> None:
            for w in (*known[cluster]["tokens"], *known[cluster]["ents"]):
                holders.setdefault(w, set()).add(cluster)

        for c in known:
            place(c)
        out, touched = [], set()
        for r in batch.itertuples():
            at = int(r.ts.timestamp() * 1000)
            item = dict(tokens=list(r.tokens), ents=list(r.ents), action=r.action, bucket=int(r.bucket), rank=[int(x) for x in r.rank], rep=r.key, last=at)
            fresh = lambda c: at - known[c]["last"] <= self.days * 86_400_000
            cluster = r.fp if r.fp in known and fresh(r.fp) else None
            if cluster is None:
                near = {c for w in (*item["tokens"], *item["ents"]) for c in holders.get(w, ()) if fresh(c)}
                found = [(-jaccard, c) for c in near for jaccard, same in [self.compare(item, known[c])] if same]
                cluster = min(found)[1] if found else None
            is_new = cluster is None
            cluster = r.fp if is_new else cluster
            if is_new or item["rank"] > known[cluster]["rank"]:
                known[cluster] = item
                place(cluster)
            known[cluster]["last"] = max(at, known[cluster]["last"])
            touched.add(cluster)
            out.append((key[0], cluster, r.key, is_new, known[cluster]["rep"]))
        for c in touched:
            self.clusters.updateValue((c,), tuple(known[c][n] for n in names))
            self.handle.registerTimer(known[c]["last"] + self.days * 86_400_000 + 1)
        yield pd.DataFrame(out, columns=["block", "cluster", "key", "is_new", "representative"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = expiredTimerInfo.getExpiryTimeInMs()
        for c in [c[0] for c, v in self.clusters.iterator() if now - v[6] > self.days * 86_400_000]:
            self.clusters.removeKey((c,))
        yield pd.DataFrame([], columns=["block", "cluster", "key", "is_new", "representative"])

    def close(self) -> None:
        pass


def event_index(items: DataFrame, generic: list[str], days: int = 10, late: str = "72 hours", alone: float = 0.62, soft: float = 0.25) -> DataFrame:
    """block, cluster, key, is_new, representative for a stream of items (ITEM), each as it comes; see EventIndex.

    Blocks are what may be one event at all, such as an action in a market: a block's items of one batch meet in one task. Items reach the index in
    the order of batches, within one in that of time. An item later than `late` against the newest one is dropped, as its
    cluster may be gone. The state store must be RocksDB, see use_rocksdb().
    """
    timed = items.withWatermark("ts", late)
    schema = "block string, cluster string, key string, is_new boolean, representative string"
    return timed.groupBy("block").transformWithStateInPandas(EventIndex(days, likeness(generic, alone, soft)), schema, "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that map state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
