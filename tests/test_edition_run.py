"""The edition job against a plain loop over days: folding, gates, swaps, quotas, refills, earlier days."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.operators import edition_run as E
from tidewire.operators import editions, pairs

GENERIC = ["the", "plan"]
WORDS = ["acorn", "acme", "merger", "merge", "deal", "bank", "bankers", "plan", "court", "fraud", "rates", "bonds", "leak", "audit", "crypto", "fund", "tower", "river", "green", "steel", "the", "cargo", "lemon", "pilot"]
KINDS = {
    "audience": "string", "ts": "timestamp", "cluster": "string", "technical": "boolean", "published": "boolean", "readable": "boolean", "origin": "long",
    **{k: v for k, v in E.FACTS.items() if k != "ts"},
}
SAME, STRICT = editions.alike(GENERIC), editions.alike(GENERIC, strict=True)


def made(r, days, each, audiences):
    rows = []
    for audience in audiences:
        for k in range(days * each):
            at = 1_700_000_000 + r.randrange(days * E.DAY)
            tokens = r.sample(WORDS, r.randint(1, 4))
            row = dict(
                audience=audience, at=at, cluster=r.choice([None, None, "", f"c{r.randrange(8)}"]), technical=r.random() < 0.1, published=r.random() < 0.15, readable=r.random() < 0.6,
                origin=r.choice([None, at - r.randrange(40 * 3600)]), key=f"{audience}{k:04}", score=r.randrange(70), fit=r.randrange(60), bonus=r.choice([0, 5, 15]), coverage=r.randrange(12),
                category=r.choice("mmwxy"), head=r.choice(["A", "B", "C"]), pr=r.random() < 0.15, shared=r.random() < 0.1, fresh=r.random() < 0.3, fact=r.random() < 0.3,
                themes=r.sample(["t", "u"], r.randrange(2)), issues=["leak"] if r.random() < 0.2 else [], tokens=tokens, ents=r.sample(["Acme", "Bank", "Quay", "Reef", "Sand"], r.choice([0, 1, 1, 2])), action=r.choice("ab"),
                telling=r.sample(["tor", "storm", "gal"], 1) if r.random() < 0.2 else [], running=["quake"] if r.random() < 0.1 else [], articles=[f"a{r.randrange(60)}"] if r.random() < 0.5 else [],
            )
            rows.append(row)
    return rows


class Plain:
    """An audience's editions in a loop over all rows at hand."""

    def __init__(self, policy):
        self.q, self.past, self.last_pr = policy, [], None

    def fold(self, rows):
        groups = []
        for r in sorted(rows, key=lambda r: (-r["coverage"], -r["score"], r["key"])):
            own = next((g for g in groups if SAME(r, g[0])), None)
            own.append(r) if own else groups.append([r])
        return groups

    def edition(self, rows, day, since, until):
        q = self.q
        window = [r for r in rows if since < r["at"] <= until]
        best = {}
        for r in sorted(window, key=lambda r: (-r["coverage"], -r["score"], r["key"])):
            best.setdefault("_" + r["cluster"] if r["cluster"] else "solo" + r["key"], r)
        told = lambda r, after: any(p["at"] > after and STRICT(r, p) for p in self.past)
        articles = {a for p in self.past for a in p["articles"]}
        issues = {t for p in self.past if p["at"] > since - 2 * E.DAY for t in p["issues"]}
        story = {w for p in self.past if p["at"] > since - 3 * E.DAY for w in p["telling"]}
        picked, phase_of = [], {}
        categories, heads, themes = Counter(), Counter(), Counter()

        def blocked(r, known=True):
            words = set(r["running"]) | (set(r["telling"]) & story)
            if known and not r["fact"] and (any(len(w) >= 4 for w in words) or len(words) >= 2):
                return True
            return any((known and t in issues and not r["fresh"]) or any(t in p["issues"] for p in picked) for t in r["issues"])

        def take(r, phase, category, head):
            picked.append(r)
            phase_of[r["key"]] = phase
            categories[category] += 1
            heads[head] += 1
            themes.update(r["themes"])

        new = lambda r: not any(SAME(r, p) for p in picked)
        capped = lambda r: any(themes[t] >= q.theme_caps.get(t, 99) for t in r["themes"])

        def stand_in(group):
            use = next((m for m in group if m["readable"]), None)
            return use if use and not use["shared"] and new(use) and not blocked(use) else None

        left = []
        for g in self.fold(best.values()):
            r = g[0]
            if not (r["published"] or r["technical"] or r["shared"] or told(r, until - 2 * E.DAY) or articles & set(r["articles"])):
                left.append(g)
        by_rank = lambda g: (-(g[0]["score"] + g[0]["bonus"]), -g[0]["coverage"], -g[0]["score"], g[0]["key"])
        promotions, usual = (sorted((g for g in left if g[0]["pr"] == pr), key=by_rank) for pr in (True, False))
        if self.last_pr is not None and until - self.last_pr < 2 * E.DAY:
            promotions = []
        for category, floor in q.floors.items():
            for g in sorted((g for g in usual if g[0]["category"] == category and g[0]["score"] >= 20), key=lambda g: (-g[0]["score"], -g[0]["coverage"], g[0]["key"])):
                if floor and not capped(g[0]) and not blocked(g[0]) and new(g[0]) and (use := stand_in(g)):
                    take(use, E.FLOOR, category, use["head"])
                    floor -= 1
        for g in promotions[:1] + usual:
            r = g[0]
            if len(picked) < q.count and r not in picked and categories[r["category"]] < q.caps.get(r["category"], 2) and not capped(r) and heads[r["head"]] < q.per_head:
                if not blocked(r) and new(r) and (use := stand_in(g)):
                    take(use, E.USUAL, r["category"], r["head"])

        def refill(rows, phase, back, least, head, theme, category):
            for r in sorted((g[0] for g in self.fold(rows)), key=lambda r: (-(r["fit"] + r["bonus"]), -r["coverage"], -r["score"], r["key"])):
                if len(picked) >= q.count or r["fit"] < least or r["shared"] or r["technical"] or r["pr"] or not r["readable"] or r in picked:
                    continue
                if phase == E.FILL and r["origin"] is not None and r["origin"] < since:
                    continue
                if back and r["origin"] is not None and r["origin"] < since - q.fill_days * E.DAY:
                    continue
                if articles & set(r["articles"]) or told(r, since - (back + 2) * E.DAY) or not new(r) or (head and heads[r["head"]] >= q.per_head) or (theme and capped(r)):
                    continue
                if (category and categories[r["category"]] >= q.caps.get(r["category"], 2)) or blocked(r, not back):
                    continue
                take(r, phase, r["category"], r["head"])

        refill(window, E.TOP_UP, 0, q.topup_least, True, True, False)
        for back in range(1, q.fill_days + 1):
            refill([r for r in rows if since - back * E.DAY < r["at"] <= since - (back - 1) * E.DAY], E.BACK + back, back, q.topup_least, True, True, True)
        refill(window, E.FILL, 0, -1, False, False, False)
        self.past += picked
        if any(p["pr"] for p in picked):
            self.last_pr = until
        ranked = sorted(picked, key=lambda p: (p["pr"], -(p["score"] + p["bonus"]), p["key"]))
        return [(day, k + 1, p["key"], phase_of[p["key"]]) for k, p in enumerate(ranked)]


def frame(spark, rows):
    kinds = {k: v for k, v in KINDS.items()}
    df = spark.createDataFrame([tuple(r["at"] if c == "ts" else r[c] for c in kinds) for r in rows], ", ".join(f"{c} {'long' if c == 'ts' else t}" for c, t in kinds.items()))
    return E.slotted(df.withColumn("ts", F.timestamp_seconds("ts"))).withColumn("ts", F.unix_timestamp("ts"))


def plain(rows, policy):
    out = []
    for audience in sorted({r["audience"] for r in rows}):
        own, loop = [r for r in rows if r["audience"] == audience], Plain(policy)
        opens = -63000 + 32400
        for day in sorted({-(-(r["at"] - opens) // E.DAY) - 1 + b for r in own for b in range(policy.fill_days + 1)}):
            since = day * E.DAY + opens
            out += [(audience, *x) for x in loop.edition(own, day, since, since + 83400)]
    return out


@pytest.mark.parametrize("fill_days", [0, 2])
def test_editions_of_several_days_equal_the_plain_loop(spark, fill_days):
    r = random.Random(fill_days + 1)
    rows = made(r, 5, 40, ["p", "q"])
    rows = [x for x in rows if not (x["audience"] == "q" and r.random() < 0.6)]  # few candidates, so that refills are used
    policy = E.Policy(SAME, STRICT, caps={"m": 3, "y": 1}, theme_caps={"t": 1}, floors={"w": 2, "x": 1}, count=6, per_head=3, fill_days=fill_days)
    by = ["audience", "edition"]
    groups = E.grouped(frame(spark, rows), by, lambda a, b: pairs.same_story(a, b, GENERIC), GENERIC, fill_days)
    offered = E.offers(groups, by, policy).persist()
    expected = sorted(plain(rows, policy))
    found = lambda df: sorted((x.audience, x.edition, x.place, x.key, x.phase) for x in df.collect())
    whole = E.run(offered, by, policy)
    assert found(whole) == expected
    phases = {x[4] for x in expected}
    assert {E.FLOOR, E.USUAL, E.TOP_UP, E.FILL} <= phases and (not fill_days or E.BACK + 1 in phases)

    days, state = sorted({x[1] for x in expected}), None
    for day in days[:3]:  # an edition at a time, over a state table
        new = E.run(offered.where(F.col("edition") == day), by, policy, state)
        new = spark.createDataFrame(new.collect(), new.schema)
        state = new if state is None else state.unionByName(new)
    assert found(state) == [x for x in expected if x[1] in days[:3]]
    assert E.run(offered.where("false"), by, policy).count() == 0


def test_a_swapped_member_is_judged_anew(spark):
    """The leader can't be read; the member that stands in for it tells a story that was taken, so the group is left."""
    base = dict(audience="p", cluster=None, technical=False, published=False, readable=True, origin=None, score=50, fit=40, bonus=0, category="m", head="A", pr=False, shared=False, fresh=False, fact=False, themes=[], issues=[], action="a", telling=[], running=[], articles=[])
    at = 1_700_000_000
    rows = [
        {**base, "at": at, "key": "k1", "coverage": 9, "tokens": ["steel", "tower"], "ents": [], "score": 60},
        {**base, "at": at + 1, "key": "k2", "coverage": 8, "tokens": ["lemon", "pilot"], "ents": [], "readable": False},
        {**base, "at": at + 2, "key": "k3", "coverage": 7, "tokens": ["lemon", "cargo"], "ents": []},
        {**base, "at": at + 3, "key": "k4", "coverage": 6, "tokens": ["river", "bonds"], "ents": [], "readable": False},
        {**base, "at": at + 4, "key": "k5", "coverage": 5, "tokens": ["river", "green"], "ents": [], "shared": True},
    ]
    policy = E.Policy(SAME, STRICT, topup_least=99)
    groups = E.grouped(frame(spark, rows), ["edition"], lambda a, b: pairs.same_story(a, b, GENERIC), GENERIC)
    assert {r.key: r.leader.split("\u0001")[-1] for r in groups.collect()} == {"k1": "k1", "k2": "k2", "k3": "k2", "k4": "k4", "k5": "k4"}
    got = [(r.key, r.phase) for r in E.run(E.offers(groups, ["edition"], policy), ["edition"], policy).orderBy("place").collect()]
    assert got == [("k1", E.USUAL), ("k3", E.USUAL)]


def test_words_repeated_in_the_days_before(spark):
    policy = E.Policy(SAME, STRICT)
    rows = [(k * 3600 * 20 + 1_700_000_000, ["storm", "gal"]) for k in range(4)] + [(1_700_000_000, ["rare"])]
    published = E.slotted(spark.createDataFrame(rows, "at long, telling array<string>").withColumn("ts", F.timestamp_seconds("at")))
    got = {(r.edition, r.word) for r in E.repeated(published, ["edition"], policy).collect()}
    slots = {r.at: (r.edition, r.until) for r in published.collect()}
    expected = set()
    for e in range(min(s[0] for s in slots.values()), max(s[0] for s in slots.values()) + 5):
        until = next(u - (x - e) * E.DAY for x, u in slots.values())
        if sum(until - 3 * E.DAY < at <= until for at, words in rows if "storm" in words) >= 3:
            expected.add((e, "storm"))
    assert got == expected and expected


def test_many_copies_in_one_window_fold_without_a_table_of_pairs(spark):
    n = 15_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("edition"), F.lit(True).alias("inside"), F.lit(1).alias("coverage"), F.col("id").cast("int").alias("score"), F.lit("").alias("cluster"), F.array(F.lit("harbour"), F.lit("strike")).alias("tokens"), F.array().cast("array<string>").alias("ents"), F.lit("deal").alias("action"))
    got = E.grouped(rows, ["edition"], lambda a, b: pairs.same_story(a, b, []), [], 1)
    best = got.where(F.col("key") == str(n - 1)).select("id").first().id
    counted = got.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.count_if("alone").alias("alone"), F.count_if("alone_in_slot").alias("slot")).collect()
    assert [tuple(x) for x in counted] == [(best, n, 1, 1)]


def test_folds_leave_nothing_staged_but_their_result(spark):
    """Rounds carry numbers and are deleted; texts aren't staged with the candidates."""
    from tidewire.operators import clusters
    from tidewire.plans import curation

    folder = clusters.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    rows = [(f"k{n:03}", 1, True, n % 9, n % 50, "", [f"w{n % 40}", f"v{n % 7}"], [], "deal") for n in range(200)]
    rows = spark.createDataFrame(rows, "key string, edition int, inside boolean, coverage int, score int, cluster string, tokens array<string>, ents array<string>, action string")
    got = E.grouped(rows, ["edition"], lambda a, b: pairs.same_story(a, b, []), [], 1)
    kept = set(os.listdir(folder)) - before
    assert len(kept) == 1 and got.count() == 200
    assert not {"body", "title"} & set(curation._candidates(spark, "/root/testdata/sf0.001").columns)


def test_known_stories_meet_by_what_they_share(spark):
    r = random.Random(9)
    rows = [(k, r.randrange(3), r.sample(WORDS, r.randint(1, 4)), r.sample(["Acme", "Bank", "Quay"], r.randrange(3)), r.choice("ab"), r.random() < 0.4) for k in range(120)]
    df = spark.createDataFrame(rows, "key long, edition int, tokens array<string>, ents array<string>, action string, known boolean")
    blocks = pairs.story_blocks(df, GENERIC)
    rule = lambda a, b: pairs.same_story(a, b, GENERIC, strict=True)
    known = blocks.where("known").withColumn("edition", F.col("edition") + 1)
    got = [x.key for x in pairs.like_known(blocks, known, rule, ["ents", "telling", "rare"], ["tokens", "ents", "action"], equal=("edition",)).collect()]
    every = df.select(F.struct("*").alias("a")).crossJoin(df.where("known").select(F.struct("*").alias("b"))).where("a.edition = b.edition + 1")
    want = {x.key for x in every.where(rule(F.col("a"), F.col("b"))).select("a.key").collect()}
    assert set(got) == want and len(got) == len(want) > 10
