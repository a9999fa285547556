"""Editions day after day as one job: folding, gates, quotas, refills, where each edition knows those before it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators import clusters, pairs

DAY = 86400
#: The phases of an edition in their order. HISTORY rows are picks of earlier editions; earlier days follow each other from BACK + 1 on.
HISTORY, FLOOR, USUAL, TOP_UP, BACK, FILL = -1, 0, 1, 2, 10, 1000
#: What an offer, and a pick, must tell.
FACTS = {
    "key": "string", "ts": "long", "score": "int", "fit": "int", "bonus": "int", "coverage": "int", "category": "string", "head": "string", "pr": "boolean", "shared": "boolean", "fresh": "boolean", "fact": "boolean",
    "themes": "array<string>", "issues": "array<string>", "tokens": "array<string>", "ents": "array<string>", "action": "string", "telling": "array<string>", "running": "array<string>", "articles": "array<string>",
}
#: What later editions need of a pick, and so the columns of the state table, besides those of `by`.
STATE = ["edition", "key", "place", "phase", "pr", "until", "ts", "tokens", "ents", "action", "issues", "telling", "articles"]


@dataclass(frozen=True)
class Policy:
    """Caps, floors and rules of an edition.

    same and same_strict: two rows (tokens, ents, action) tell one story; the first is the newer. fill_days: how many days back free places
    may be filled from. Days are those of a row's time against the edition's window: recent editions count for 2 days, their
    words for 3, and a promotion comes 2 days after the last.
    """

    same: Callable[[dict, dict], bool]
    same_strict: Callable[[dict, dict], bool]
    caps: dict[str, int] = field(default_factory=dict)
    theme_caps: dict[str, int] = field(default_factory=dict)
    floors: dict[str, int] = field(default_factory=dict)
    count: int = 10
    per_head: int = 4
    default_cap: int = 2
    floor_least: int = 20
    topup_least: int = 30
    fill_days: int = 0
    recent_days: int = 2
    story_days: int = 3
    promotion_days: int = 2
    story_words: int = 2
    story_length: int = 4


def slotted(rows: DataFrame, ts: str = "ts", opens: int = -63000 + 32400, length: int = 83400) -> DataFrame:
    """rows with edition, a day number, since, until (seconds) and inside: the day-long slot that their time falls into, and whether it is in the edition's window.

    Slots follow each other: (since, since + a day]; the window is (since, since + length]. opens: the start of day 0's slot, in
    seconds; by default 6:50 of the day before to 6:00 in a zone nine hours ahead. A row without a time is left out.
    """
    at = F.unix_timestamp(ts)
    day = F.ceil((at - opens) / DAY) - 1
    since = day * DAY + opens
    return rows.where(F.col(ts).isNotNull()).withColumns({"edition": day.cast("int"), "since": since.cast("long"), "until": (since + length).cast("long"), "inside": at <= since + length})


def _name(by: list[str]) -> Column:
    return F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in [*by, "edition", "key"]))


def grouped(rows: DataFrame, by: list[str], rule: Callable[[Column, Column], Column], generic: list[str], fill_days: int = 0) -> DataFrame:
    """rows of slotted() with id, leader (of the window's groups), alone and alone_in_slot (leads a group of all rows of the window, the slot).

    Groups are folded in two steps: of each cluster the row that covers most, by score and key; then, in that order, a row joins the first leader
    whose story it tells by rule(row, leader), which reads tokens, ents and action. Rows without a cluster are clusters of their own. The refills fold all rows, not only
    those of the first step. Like rows share a block of pairs.story_blocks(), and all folds run as one clusters.blocked_leaders().
    """
    rank = F.struct((-F.col("coverage")).alias("c"), (-F.col("score")).alias("s"), F.col("key").alias("k"))
    named = clusters.staged(rows.withColumns({"id": _name(by), "rank": rank}))
    clusters.release(rows.sparkSession)
    known = [c for c in by if c != "edition"]
    light = pairs.story_blocks(named.select("id", "rank", *known, "edition", "tokens", "ents", "action"), generic, "id")

    # Which folds a row takes part in; only rows of one fold, audience and edition fold into each other.
    solo = F.when(F.coalesce(F.col("cluster").cast("string"), F.lit("")) == "", F.concat(F.lit("_solo:"), "key")).otherwise(F.concat(F.lit("_"), F.col("cluster").cast("string")))
    first = F.row_number().over(Window.partitionBy(*known, "edition", "inside", solo).orderBy("rank")) == 1
    folds = {"leader": F.col("inside") & first, "window": F.col("inside")} | ({"slot": F.lit(True)} if fill_days else {})
    part = F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in folds.items())))
    each = light.join(named.select("id", part.alias("folds")), "id").withColumn("fold", F.explode("folds")).drop("folds")
    each = each.withColumn("id", F.struct("fold", "id"))
    leaders = clusters.blocked_leaders(each, ["ents", "telling", "rare"], rule, ("fold", *known, "edition"), ["tokens", "ents", "action"])
    led = leaders.select("id.fold", "id.id", F.col("leader.id").alias("l"))
    of = lambda f: F.max(F.when(F.col("fold") == f, F.col("l")))
    flat = led.groupBy("id").agg(of("leader").alias("leader"), F.coalesce(of("window") == F.col("id"), F.lit(False)).alias("alone"), F.coalesce(of("slot") == F.col("id"), F.lit(False)).alias("alone_in_slot"))
    none = F.lit(False)
    groups = clusters.staged(named.drop("rank").join(flat, "id", "left").withColumns({"alone": F.coalesce("alone", none), "alone_in_slot": F.coalesce("alone_in_slot", none)}))
    clusters.drop_staged(named, leaders)
    clusters.release(rows.sparkSession)
    return groups


def offers(groups: DataFrame, by: list[str], policy: Policy) -> DataFrame:
    """What is offered to each edition, with phase and order: by, edition, since, until, phase, own (the facts judged), use (the facts that would be taken).

    A leader offers the first readable member of its group, by coverage, score and key, or nothing; in the refills a row offers itself.
    groups: by way of grouped(), with the columns of FACTS, readable, published (told before the window), technical.
    """
    known = [c for c in by if c != "edition"]
    facts = F.struct(*FACTS)
    rank = F.struct((-F.col("coverage")).alias("c"), (-F.col("score")).alias("s"), F.col("key").alias("k"))
    readable = groups.where("readable AND leader IS NOT NULL")
    swap = readable.groupBy(F.col("leader").alias("id")).agg(F.min_by(facts, rank).alias("use"))
    base = ["id", *known, "edition", "since", "until"]

    leading = groups.where("leader = id AND NOT published AND NOT technical AND NOT shared").join(swap, "id", "left")
    place = F.array_position(F.array(*map(F.lit, policy.floors)), F.col("category")) if policy.floors else F.lit(0).cast("long")
    reserved = [c for c, n in policy.floors.items() if n > 0]
    floor = leading.where(~F.col("pr") & (F.col("score") >= policy.floor_least) & F.col("category").isin(reserved)) if reserved else leading.where("false")
    floor = floor.select(*base, F.lit(FLOOR).alias("phase"), F.struct(place.alias("o1"), (-F.col("score")).alias("o2"), rank.alias("o3")).alias("order"), facts.alias("own"), "use")
    ranked = lambda first, points: F.struct(first.cast("long").alias("o1"), (-points).cast("int").alias("o2"), rank.alias("o3")).alias("order")
    usual = leading.select(*base, F.lit(USUAL).alias("phase"), ranked((~F.col("pr")).cast("long"), F.col("score") + F.col("bonus")), facts.alias("own"), "use")

    own = groups.where("readable AND NOT pr AND NOT technical AND NOT shared")
    points = F.col("fit") + F.col("bonus")
    refill = lambda rows, phase: rows.select(*base, phase.alias("phase"), ranked(F.lit(0), points), facts.alias("own"), facts.alias("use"))
    topup = refill(own.where(F.col("alone") & (F.col("fit") >= policy.topup_least)), F.lit(TOP_UP))
    fill = refill(own.where(F.col("alone") & F.coalesce(F.col("origin") >= F.col("since"), F.lit(True))), F.lit(FILL))
    out = floor.unionByName(usual).unionByName(topup).unionByName(fill)
    if policy.fill_days:
        # A row is offered to the editions of the days after it; the oldest origin that an edition takes follows its own window.
        earlier = own.where(F.col("alone_in_slot") & (F.col("fit") >= policy.topup_least)).withColumn("__back", F.explode(F.sequence(F.lit(1), F.lit(policy.fill_days))))
        moved = {c: F.col(c) + F.col("__back") * (1 if c == "edition" else DAY) for c in ("edition", "since", "until")}
        moved = earlier.withColumns({**moved, "edition": moved["edition"].cast("int")})
        recent = F.coalesce(F.col("origin") >= F.col("since") - policy.fill_days * DAY, F.lit(True))
        out = out.unionByName(refill(moved.where(recent), BACK + F.col("__back")))
    return out.drop("id")


class Desk:
    """Fills the editions of one audience in order, and remembers what later ones must know: the picks of a few days, all articles, the last promotion."""

    def __init__(self, policy: Policy):
        self.policy, self.recent, self.articles, self.promoted = policy, [], set(), None
        self.edition = None

    def remember(self, pick: dict) -> None:
        """A pick of an earlier edition."""
        self.recent.append(pick)
        self.articles.update(pick["articles"] or ())
        if pick["pr"]:
            self.promoted = pick["until"] if self.promoted is None else max(self.promoted, pick["until"])

    def open(self, edition: int, since: int, until: int) -> None:
        self.edition, self.since, self.until = edition, since, until
        back = max(self.policy.recent_days, self.policy.story_days) + self.policy.fill_days + 1
        self.recent = [p for p in self.recent if p["ts"] > since - back * DAY]
        self.picked, self.taken = [], set()
        self.categories, self.heads, self.themes, self.issues, self.floors = Counter(), Counter(), Counter(), Counter(), Counter(self.policy.floors)
        self.promotion = None
        self.prior_issues = {t for p in self.recent if p["ts"] > since - self.policy.recent_days * DAY for t in p["issues"] or ()}
        self.story = {w for p in self.recent if p["ts"] > since - self.policy.story_days * DAY for w in p["telling"] or ()}

    def close(self) -> list[dict]:
        """The picks in their order, promotions last; they are remembered."""
        done = sorted(self.picked, key=lambda p: (p["pr"], -(p["score"] + p["bonus"]), p["key"]))
        for k, p in enumerate(done):
            p["place"] = k + 1
        for p in done:
            self.remember(p)
        return done

    def full(self) -> bool:
        return len(self.picked) >= self.policy.count

    def offer(self, own: dict, use: dict | None, phase: int) -> None:
        q = self.policy
        if phase == FLOOR:
            if self.floors[own["category"]] <= 0 or self._told(own, self.until - q.recent_days * DAY) or self._used(own):
                return
            if self._in_theme(own) and not self._blocked(own) and self._new(own) and self._swapped(use):
                self.floors[own["category"]] -= 1
                self._take(use, phase, own["category"], use["head"])
            return
        if self.full():
            return
        if phase == USUAL:
            if self._told(own, self.until - q.recent_days * DAY) or self._used(own):
                return
            if own["pr"]:  # the first promotion that is left counts, and it must wait for its turn
                first = self.promotion is None
                self.promotion = own["key"] if first else self.promotion
                if not first or (self.promoted is not None and self.until - self.promoted < q.promotion_days * DAY):
                    return
            fits = own["key"] not in self.taken and self._in_category(own) and self._in_theme(own) and self.heads[own["head"]] < q.per_head
            if fits and not self._blocked(own) and self._new(own) and self._swapped(use):
                self._take(use, phase, own["category"], own["head"])
            return
        back = phase - BACK if BACK < phase < FILL else 0
        if own["key"] in self.taken or self._used(own) or self._told(own, self.since - (back + q.recent_days) * DAY) or not self._new(own):
            return
        if phase != FILL:
            if self.heads[own["head"]] >= q.per_head or (back and not self._in_category(own)) or not self._in_theme(own):
                return
        if not self._blocked(own, known=not back):
            self._take(own, phase, own["category"], own["head"])

    def _told(self, row: dict, after: int) -> bool:
        """Whether a recent edition told the story, by picks from after a time."""
        return any(p["ts"] > after and self.policy.same_strict(row, p) for p in self.recent)

    def _used(self, row: dict) -> bool:
        return any(a in self.articles for a in row["articles"] or ())

    def _new(self, row: dict) -> bool:
        return not any(self.policy.same(row, p) for p in self.picked)

    def _swapped(self, use: dict | None) -> bool:
        """Whether what stands in for a leader can be taken: readable, not shared, no story of this edition, no issue that is used up."""
        return use is not None and not use["shared"] and self._new(use) and not self._blocked(use)

    def _in_category(self, row: dict) -> bool:
        return self.categories[row["category"]] < self.policy.caps.get(row["category"], self.policy.default_cap)

    def _in_theme(self, row: dict) -> bool:
        return not any(self.themes[t] >= self.policy.theme_caps[t] for t in row["themes"] if t in self.policy.theme_caps)

    def _blocked(self, row: dict, known: bool = True) -> bool:
        """The issue gate: a running story (known words), an issue of recent editions unless the row brings news, an issue of this edition."""
        if known and not row["fact"]:
            words = {*(row["running"] or ()), *(w for w in row["telling"] or () if w in self.story)}
            if any(len(w) >= self.policy.story_length for w in words) or len(words) >= self.policy.story_words:
                return True
        return any((known and t in self.prior_issues and not row["fresh"]) or self.issues[t] for t in row["issues"] or ())

    def _take(self, row: dict, phase: int, category: str, head: str) -> None:
        self.picked.append({**row, "phase": phase, "edition": self.edition, "until": self.until})
        self.taken.add(row["key"])
        self.categories[category] += 1
        self.heads[head] += 1
        self.themes.update(row["themes"])
        self.issues.update(row["issues"] or ())


def state_schema(df: DataFrame, by: list[str]) -> str:
    known = [f"{c} {df.schema[c].dataType.simpleString()}" for c in by if c != "edition"]
    kinds = FACTS | {"edition": "int", "place": "int", "phase": "int", "until": "long"}
    return ", ".join([*known, *(f"{c} {kinds[c]}" for c in STATE)])


def run(offered: DataFrame, by: list[str], policy: Policy, history: DataFrame | None = None) -> DataFrame:
    """The picks of all editions, with what later editions need to know (STATE): append them to the state table, and pass it as history next time.

    history: the state table of editions before the first offered one. An audience (by) is one stream of offers in the order of editions, phases and
    ranks, sorted by Spark and read batch by batch; it holds its picks of a few days and the articles that it took, ten a day, so memory
    doesn't grow with the candidates. Audiences run side by side. Editions run one at a time or all at once give the same picks.
    """
    known = [c for c in by if c != "edition"]
    schema = state_schema(offered, by)
    facts = ", ".join(f"{c}: {t}" for c, t in FACTS.items())
    columns = [*known, "edition", "since", "until", "phase", "order", "own", "use"]
    rows = offered.select(*columns)
    if history is not None:
        kept = [F.col(c) if c in STATE else F.lit(None).cast(t).alias(c) for c, t in FACTS.items()]
        past = history.select(*known, "edition", F.lit(0).cast("long").alias("since"), "until", F.lit(HISTORY).alias("phase"), F.lit(None).cast(rows.schema["order"].dataType).alias("order"), F.struct(*kept).cast(f"struct<{facts}>").alias("own"))
        rows = rows.unionByName(past.withColumn("use", F.lit(None).cast(f"struct<{facts}>")))
    lane = known or [F.lit(0)]
    ordered = rows.repartition(*lane).sortWithinPartitions(*known, "edition", "phase", "order")

    def fill(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        kind = pa.schema([(name, kinds[t]) for name, t in (column.split(" ", 1) for column in schema.split(", "))])
        desk, lane_now = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**dict(zip(known, lane_now)), **{c: p[c] for c in STATE}} for p in desk.close()], schema=kind)

        for batch in batches:
            heads = batch.select([*known, "edition", "phase"]).to_pylist()
            own, use = batch.column("own"), batch.column("use")
            for k, r in enumerate(heads):
                lane = tuple(r[c] for c in known)
                if desk is None or lane != lane_now:
                    if desk is not None and desk.edition is not None:
                        yield closed()
                    desk, lane_now = Desk(policy), lane
                if r["phase"] == HISTORY:
                    desk.remember({**own[k].as_py(), "until": batch.column("until")[k].as_py()})
                    continue
                if r["edition"] != desk.edition:
                    if desk.edition is not None:
                        yield closed()
                    desk.open(r["edition"], batch.column("since")[k].as_py(), batch.column("until")[k].as_py())
                if r["phase"] == FLOOR or not desk.full():
                    desk.offer(own[k].as_py(), use[k].as_py(), r["phase"])
        if desk is not None and desk.edition is not None:
            yield closed()

    return ordered.mapInArrow(fill, schema)


def repeated(published: DataFrame, by: list[str], policy: Policy, times: int = 3) -> DataFrame:
    """by, edition, words: the long words that at least so many published rows (ts, telling) of the days before an edition's end share.

    published has the columns of slotted(). A row counts for the editions whose last days it lies in, so it is repeated once for each, not
    joined with them.
    """
    known = [c for c in by if c != "edition"]
    each = published.withColumn("__on", F.explode(F.sequence(F.lit(0), F.lit(policy.story_days))))
    each = each.withColumns({"edition": (F.col("edition") + F.col("__on")).cast("int"), "until": F.col("until") + F.col("__on") * DAY})
    near = each.where((F.unix_timestamp("ts") <= F.col("until")) & (F.unix_timestamp("ts") > F.col("until") - policy.story_days * DAY))
    words = near.select(*known, "edition", F.explode(F.array_distinct("telling")).alias("word")).groupBy(*known, "edition", "word").agg(F.count(F.lit(1)).alias("n"))
    return words.where((F.col("n") >= times) & (F.length("word") >= policy.story_length)).select(*known, "edition", "word")


def with_running(rows: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """rows with `running`, their telling words that stand in words (by, edition, word) of their edition."""
    known = [c for c in by if c != "edition"]
    each = rows.select(*known, "edition", "key", F.explode("telling").alias("word")).join(words, [*known, "edition", "word"], "left_semi")
    found = each.groupBy(*known, "edition", "key").agg(F.array_sort(F.collect_set("word")).alias("running"))
    return rows.join(found, [*known, "edition", "key"], "left").withColumn("running", F.coalesce("running", F.array().cast("array<string>")))

