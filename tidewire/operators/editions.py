"""Editions: diversified top lists under quotas."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def brief(rows: DataFrame, by: list[str], count: int = 10, per_head: int = 4) -> DataFrame:
    """rows (key, cluster, tier, score, head) with `place`: the best of each cluster by tier and score, at most per_head of a head.

    Places left over go to those over the cap, in order. All in windows: the cap is a rank within the head, and the final order is
    (over the cap, rank).
    """
    best = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, F.coalesce("cluster", F.concat(F.lit("_solo:"), "key"))).orderBy(F.col("score").desc(), "key"))).where("__rn = 1").drop("__rn")
    order = ["tier", F.col("score").desc(), "key"]
    ranked = best.withColumn("__in_head", F.row_number().over(Window.partitionBy(*by, "head").orderBy(*order)))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy((F.col("__in_head") > per_head).cast("int"), *order)))
    return ranked.where(F.col("place") <= count).drop("__in_head")


def capped(rows: DataFrame, by: list[str], category: str, caps: dict[str, int], default: int, order: list) -> DataFrame:
    """The first rows of each category up to its cap."""
    cap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col(category)), F.lit(default)) if caps else F.lit(default)
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, category).orderBy(*order))).where(F.col("__rn") <= cap).drop("__rn")


def in_issue_order(rows: DataFrame, by: list[str], usual: int = 6, with_incidents: int = 12) -> DataFrame:
    """Key issues of a day in order of arrival: usual ones while fewer than `usual` were taken, incidents while fewer than with_incidents.

    An incident is taken up to the larger cap, so a usual row is taken if its own number among usual rows and the incidents before it
    stay within the smaller; the two counters make it a window.
    """
    w = Window.partitionBy(*by).orderBy("ts", "key").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumns({"__inc": F.count_if("incident").over(w), "__usual": F.count_if(~F.col("incident")).over(w)})
    taken = F.when(F.col("incident"), F.col("__inc") <= with_incidents).otherwise(F.col("__usual") + F.col("__inc") <= usual)
    return counted.where(taken).drop("__inc", "__usual")


def alike(generic: list[str], strict: bool = False) -> Callable[[dict, dict], bool]:
    """pairs.same_story for two rows that are at hand (tokens, ents, action); rows without ents go by their titles."""
    from tidewire.functions.text import NUMBER

    number = re.compile(NUMBER.replace(r"\p{L}", r"[^\W\d_]"))

    def telling(words: set) -> set:
        return {w for w in words - set(generic) if len(w) >= 2 and not number.match(w)}

    def stems(a: set, b: set) -> int:
        near = lambda x, y: x.startswith(y) or y.startswith(x) or (len(x) >= 3 and len(y) >= 3 and x[:3] == y[:3])
        return sum(len(x) >= 2 and any(len(y) >= 2 and near(x, y) for y in b) for x in a)

    def same(a: dict, b: dict) -> bool:
        x, y, names_a, names_b = set(a["tokens"]), set(b["tokens"]), set(a["ents"]), set(b["ents"])
        jaccard = len(x & y) / len(x | y) if x and y else 0.0
        shared = names_a & names_b
        if not shared:
            free = {w for w in telling(x) & telling(y) if not any(n and (w in n or n in w) for n in names_a | names_b)}
            return jaccard >= 0.62 or bool(free)
        lower = {n.lower() for n in shared}
        beyond = lambda ws: {w for w in ws - lower if not any(w.startswith(n.lower()[:2]) for n in shared if len(n) >= 2)}
        hits = stems(beyond(x), beyond(y))
        told = any(len(w) >= 3 and not any(w.startswith(n) for n in lower) for w in telling(x & y))
        return min(len(shared), 2) + (a["action"] == b["action"]) + (jaccard >= 0.25) + min(hits, 2) + told >= 3 and (hits >= 2 or not strict)

    return same


class Shelf:
    """The places of one edition while it is filled: what was taken, and whether another row fits."""

    def __init__(self, quotas: Quotas):
        self.quotas, self.picked, self.taken = quotas, [], set()
        self.categories, self.heads, self.themes, self.floors = Counter(), Counter(), Counter(), Counter(quotas.floors)
        self.promotion = None

    def full(self) -> bool:
        return len(self.picked) >= self.quotas.count

    def offer(self, r: dict, phase: int) -> None:
        """Takes a row if the phase lets it in. Rows come by phase and, within it, in the phase's order."""
        if phase == FLOOR:
            if self.floors[r["category"]] > 0 and self._fits(r, category=False, head=False):
                self.floors[r["category"]] -= 1
                self._take(r)
            return
        if r["pr"]:  # the first promotion alone is considered
            self.promotion = r["key"] if self.promotion is None else self.promotion
            if r["key"] != self.promotion:
                return
        if not self.full() and self._fits(r, category=phase == USUAL, head=phase != FILL):
            self._take(r)

    def _fits(self, r: dict, category: bool, head: bool) -> bool:
        q = self.quotas
        if r["key"] in self.taken or not r["readable"]:
            return False
        if category and self.categories[r["category"]] >= q.caps.get(r["category"], q.default_cap):
            return False
        if any(self.themes[t] >= q.theme_caps[t] for t in r["themes"] if t in q.theme_caps):
            return False
        if head and self.heads[r["head"]] >= q.per_head:
            return False
        return not any(q.same(r, p) for p in self.picked)

    def _take(self, r: dict) -> None:
        self.picked.append(r)
        self.taken.add(r["key"])
        self.categories[r["category"]] += 1
        self.heads[r["head"]] += 1
        self.themes.update(r["themes"])

    def in_order(self) -> list[dict]:
        """The picks by rank, promotions last."""
        return sorted(self.picked, key=lambda r: (r["pr"], -r["rank_score"], r["key"]))


#: The phases in which an edition is filled: reserved places, then under all caps, then without the category's cap for rows that fit
#: well, then without the head's cap too.
FLOOR, USUAL, TOP_UP, FILL = range(4)


class Quotas:
    """The order-dependent part of an edition: floors, caps, refills."""

    def __init__(self, caps: dict[str, int], theme_caps: dict[str, int], floors: dict[str, int], same: Callable, count: int = 10, per_head: int = 4, floor_least: int = 20, default_cap: int = 2):
        self.caps, self.theme_caps, self.floors, self.same = caps, theme_caps, floors, same
        self.count, self.per_head, self.floor_least, self.default_cap = count, per_head, floor_least, default_cap

    def phases(self, topup_least: int | None, fill: bool) -> Column:
        """The phases in which a row (category, fit, pr) is offered."""
        reserved = [c for c, n in self.floors.items() if n > 0]
        floor = ~F.col("pr") & (F.col("fit") >= self.floor_least) & F.col("category").isin(reserved) if reserved else F.lit(False)
        tests = {FLOOR: floor, USUAL: F.lit(True), TOP_UP: F.lit(False) if topup_least is None else F.col("fit") >= topup_least, FILL: F.lit(fill)}
        return F.array_compact(F.array(*(F.when(t, F.lit(p)) for p, t in tests.items())))

    def order(self) -> list[Column]:
        """Order of offers within an edition: by phase; floors in their own order and by fit, else the promotions and then by rank."""
        floors = F.col("__phase") == FLOOR
        place = F.array_position(F.array(*map(F.lit, self.floors)), F.col("category")) if self.floors else F.lit(0)
        return ["__phase", F.when(floors, place), F.when(floors, -F.col("fit")), (~F.col("pr")).cast("int"), F.col("rank_score").desc(), "key"]


def edition(survivors: DataFrame, by: list[str], quotas: Quotas, topup_least: int | None = 30, fill: bool = True) -> DataFrame:
    """by, key, place for each edition of survivors (by, key, rank_score, fit, category, themes, head, pr, readable, tokens).

    What is taken depends on what was taken before, so an edition is one stream of offers, sorted by Spark and read batch by batch; only
    its picks are held, so no row is cut off and memory doesn't grow with the edition. Unreadable rows, never taken, go first;
    promotions stay, as the first one counts even if it can't be read. Editions and audiences run side by side.
    """
    offers = survivors.where("readable OR pr").withColumn("__phase", F.explode(quotas.phases(topup_least, fill)))
    ordered = offers.repartition(*by).sortWithinPartitions(*by, *quotas.order())
    kinds = ", ".join(f"{c} {survivors.schema[c].dataType.simpleString()}" for c in [*by, "key"])

    def run(batches):
        import pandas as pd

        def placed(edition, shelf):
            return pd.DataFrame([(*edition, r["key"], k + 1) for k, r in enumerate(shelf.in_order())], columns=[*by, "key", "place"], dtype=object)

        edition, shelf = None, None
        for pdf in batches:
            # Batches hold few editions, so rows of one that is full are passed over as a whole.
            for own, rows in pdf.groupby(by, sort=False, dropna=False):
                if shelf is None or not _equal(own, edition):
                    if shelf is not None:
                        yield placed(edition, shelf)
                    edition, shelf = own, Shelf(quotas)
                for r in () if shelf.full() and rows["__phase"].iat[0] > FLOOR else rows.to_dict("records"):
                    shelf.offer(r, r["__phase"])
        if shelf is not None:
            yield placed(edition, shelf)

    return ordered.mapInPandas(run, f"{kinds}, place int")


def _equal(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))
