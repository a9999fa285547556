import random

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import clusters, editions, ledgers, marts, pairs, routing
from tidewire.plans import registry
from tidewire.plans import sample as S


def test_first_leaders_equal_the_greedy_pass(spark):
    r = random.Random(2)
    for n, m in ((12, 10), (60, 120), (80, 60)):
        edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
        rank = list(range(n))
        r.shuffle(rank)
        near = {k: set() for k in range(n)}
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        kept, leader = [], {}
        for k in sorted(range(n), key=rank.__getitem__):
            hits = [q for q in kept if q in near[k]]
            leader[k] = hits[0] if hits else k
            if not hits:
                kept.append(k)
        nodes = spark.createDataFrame([(k, rank[k]) for k in range(n)], "id long, rank int")
        links = spark.createDataFrame(sorted(edges), "a long, b long")
        assert {x.id: x.leader for x in clusters.first_leaders(nodes, links).collect()} == leader
    assert {x.leader for x in clusters.first_leaders(nodes, links.where("false")).collect()} == set(range(n))


def test_blocked_leaders_equal_the_greedy_pass(spark):
    """Like rows share a word; within a scope they fold as in the plain loop, also where all rows hold one word."""
    r = random.Random(3)
    for hot in (False, True):
        data = [(k, r.randrange(2), r.randrange(9), [f"w{r.randrange(30)}" for _ in range(r.randrange(4))] + ["all"] * hot) for k in range(150)]
        like = lambda a, b: len(set(a[3]) & set(b[3])) >= 1 + hot
        want, kept = {}, []
        for row in sorted(data, key=lambda x: (x[2], x[0])):
            hits = [q for q in kept if q[1] == row[1] and like(row, q)]
            want[row[0]] = hits[0][0] if hits else row[0]
            if not hits:
                kept.append(row)
        df = spark.createDataFrame(data, "id long, part int, c int, words array<string>").select("id", "part", F.struct("c", "id").alias("rank"), "words")
        rule = lambda a, b: F.size(F.array_intersect(a["words"], b["words"])) >= 1 + hot  # noqa: E731, B023
        assert {x.id: x.leader for x in clusters.blocked_leaders(df, ["words"], rule, ("part",)).collect()} == want
    many = spark.range(30_000).select("id", F.struct("id").alias("rank"), F.array(F.lit("w")).alias("words"))
    got = clusters.blocked_leaders(many, ["words"], lambda a, b: F.lit(True))
    assert [tuple(x) for x in got.groupBy("leader").count().collect()] == [(0, 30_000)]


def test_jaccard_pairs_of_classes_become_pairs_of_rows(spark):
    r = random.Random(4)
    sets = [sorted(r.sample([f"w{k}" for k in range(9)], r.randrange(5))) for _ in range(14)]
    data = [(k, r.sample(s, len(s))) for k, s in enumerate(r.choice(sets) for _ in range(200))]
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    want = sorted((a, b, jac(x, y)) for a, x in data for b, y in data if a < b and jac(x, y) >= 0.5)
    got = pairs.jaccard_pairs(spark.createDataFrame(data, "key long, tokens array<string>"), 0.5, tile_rows=7).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 1000


def test_pairs_of_one_large_class_are_spread_over_tasks(spark):
    rows = spark.range(2000).select(F.col("id").alias("key"), F.array(F.lit("same"), F.lit("words")).alias("tokens"))
    got = pairs.jaccard_pairs(rows, 0.5, tile_rows=100).withColumn("task", F.spark_partition_id())
    shares = [x["count"] for x in got.groupBy("task").count().collect()]
    assert sum(shares) == 2000 * 1999 // 2 and max(shares) < sum(shares) / 3
    assert got.select("a_id", "b_id").distinct().count() == sum(shares) and not got.where("a_id >= b_id OR jaccard != 1").count()


def test_pairs_from_counts_of_words_equal_the_rules(spark):
    """Rows that carry no words through the join give the pairs and the overlaps of their sets."""
    r = random.Random(5)
    words = ["acme", "bank", "acorn", "deal", "plan", "ab", "9", "court", "fraud", "the"]
    data = [(k, r.sample(words, r.randrange(6)), r.sample(["acme", "Acorn", "Bo"], r.choice((0, 0, 1, 2))), r.choice(("x", "y")), r.randrange(4)) for k in range(90)]
    df = spark.createDataFrame(data, "key long, tokens array<string>, ents array<string>, action string, bucket long").withColumn("ts", F.timestamp_seconds(F.col("bucket") * 86400)).withColumn("free", F.lit(True))
    every = df.select(F.struct("*").alias("a")).crossJoin(df.select(F.struct("*").alias("b"))).where("a.key < b.key AND size(array_intersect(a.tokens, b.tokens)) > 0")
    want = {(x.a.key, x.b.key) for x in every.where(pairs.same_event(F.col("a"), F.col("b"), ["the", "plan"])).collect()}
    got = [(x.a.key, x.b.key) for x in pairs.event_pairs(df, ["the", "plan"], F.col("a.key") < F.col("b.key")).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    rows = {k: (set(w), b) for k, w, _, _, b in data}
    part = lambda a, b: len(rows[a][0] & rows[b][0]) / min(len(rows[a][0]), len(rows[b][0])) if rows[a][0] and rows[b][0] else 0.0
    best = {a: min(((-part(a, b), b) for b in rows if b != a and abs(rows[a][1] - rows[b][1]) <= 2 and part(a, b) >= 0.45), default=None) for a in rows}
    assert {x.key: x.alt for x in pairs.alternatives(df, df).collect()} == {a: b[1] for a, b in best.items() if b}


def test_survivors_follow_chains_and_leave_out_circles(spark):
    rows = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 21), (21, 20), (22, 20)]
    got = {(r.loser, r.survivor) for r in clusters.survivors(spark.createDataFrame(rows, "loser long, winner long")).collect()}
    assert got >= {(1, 4), (2, 4), (3, 4), (10, 11)} and not any(a in (20, 21) for a, _ in got)


def test_blocking_loses_no_pair(spark, tmp_path):
    r = random.Random(4)
    words = [f"word{k}" for k in range(40)]
    rows = [(k, r.sample(words, r.randint(1, 6)), r.sample(["A co", "B co", "C co"], r.randint(0, 2)), r.choice(["deal", "other"]), r.randint(0, 3)) for k in range(120)]
    df = spark.createDataFrame(rows, "key long, tokens array<string>, ents array<string>, action string, bucket long")
    every = df.select(F.struct("*").alias("a")).crossJoin(df.select(F.struct("*").alias("b"))).where("a.key < b.key")
    for rule, keys in ((pairs.same_event, ["tokens"]), (pairs.same_story, ["tokens", "ents"])):
        want = {(x.a.key, x.b.key) for x in every.where(rule(F.col("a"), F.col("b"), ["word1"])).collect()}
        got = {(x.a.key, x.b.key) for x in pairs.blocked_pairs(df, df, keys, same=True).where(rule(F.col("a"), F.col("b"), ["word1"])).collect()}
        assert got == want and want
    near = every.where("a.action = b.action AND abs(a.bucket - b.bucket) <= 1 AND arrays_overlap(a.tokens, b.tokens)")
    keyed = pairs.blocked_pairs(df, df, ["tokens"], same=True, equal=("action",), next_to="bucket").collect()
    assert sorted((x.a.key, x.b.key) for x in keyed) == sorted((x.a.key, x.b.key) for x in near.collect())
    close = {(x.a.key, x.b.key) for x in every.collect() if len(set(x.a.tokens) & set(x.b.tokens)) / len(set(x.a.tokens) | set(x.b.tokens)) >= 0.4}
    assert {(x.a_id, x.b_id) for x in pairs.jaccard_pairs(df, 0.4).collect()} == close


def test_ledgers(spark):
    items = spark.createDataFrame([(1, "a", "u", 5), (2, "a", "v", 1), (3, "b", "u", 3), (4, None, "", 4), (5, None, "", 6)], "id long, key string, url string, t int")
    assert {r.id for r in ledgers.first_wins(items, ["key", "url"], [F.col("t")]).collect()} == {2, 3, 4, 5}
    ledger = spark.createDataFrame([("a", 1)], "key string, t int")
    new = ledgers.insert_or_ignore(ledger, items.where("key IS NOT NULL").select("key", "t"), ["key"], [F.col("t")])
    assert sorted((r.key, r.t) for r in new.collect()) == [("a", 1), ("b", 3)]
    assert ledgers.insert_or_ignore(new, items.where("key IS NOT NULL").select("key", "t"), ["key"], [F.col("t")]).count() == 2
    assert [r.id for r in ledgers.unseen(items, {"key": ledger}).orderBy("id").collect()] == [3, 4, 5]
    drafts = spark.createDataFrame([("e", ["1"], 5.0, 10), ("e", ["2"], 5.0, 4), ("e", ["3"], 4.0, 1)], "edition string, keys array<string>, quality double, at long").withColumn("built_at", F.timestamp_seconds("at"))
    assert ledgers.champions(drafts).first()["keys"] == ["2"]


def filled(rows, quotas, topup_least=30, fill=True):
    """The plain loop: every row of an edition in memory, a phase at a time."""
    ranked = sorted(rows, key=lambda r: (-r["rank_score"], r["key"]))
    promoted, usual = [r for r in ranked if r["pr"]][:1], [r for r in ranked if not r["pr"]]
    picked = []

    def fits(r, category, head):
        same = lambda c, v: sum(v in p[c] if c == "themes" else p[c] == v for p in picked)
        return not (
            r in picked
            or not r["readable"]
            or any(quotas.same(r, p) for p in picked)
            or (category and same("category", r["category"]) >= quotas.caps.get(r["category"], quotas.default_cap))
            or any(same("themes", t) >= n for t, n in quotas.theme_caps.items() if t in r["themes"])
            or (head and same("head", r["head"]) >= quotas.per_head)
        )

    for category, floor in quotas.floors.items():
        for r in sorted((r for r in usual if r["category"] == category and r["fit"] >= quotas.floor_least), key=lambda r: (-r["fit"], r["key"])):
            if floor and fits(r, False, False):
                picked.append(r)
                floor -= 1
    for least, category, head in [(None, True, True)] + ([(topup_least, False, True)] if topup_least is not None else []) + ([(None, False, False)] if fill else []):
        for r in [*promoted, *usual]:
            if len(picked) < quotas.count and (least is None or r["fit"] >= least) and fits(r, category, head):
                picked.append(r)
    return [r["key"] for r in sorted(picked, key=lambda r: (r["pr"], -r["rank_score"], r["key"]))]


def test_editions_equal_the_plain_loop(spark):
    r = random.Random(5)
    same = lambda a, b: a["event"] == b["event"]
    rows = []
    for day, n, good in (("a", 1500, 0.01), ("b", 1500, 0.9), ("c", 40, 0.5), (None, 30, 0.9), ("e", 3, 1.0)):
        for k in range(n):  # in the first, most rows can't be read, so the picks lie far down
            rows.append(dict(day=day, key=f"{day}{k:04}", rank_score=r.randrange(100), fit=r.randrange(60), category=r.choice("mmmwx"), themes=r.sample(["t", "u"], r.randrange(3)), head=f"h{k % 3}", pr=r.random() < 0.1, readable=r.random() < good, event=r.randrange(n)))
    kinds = "day string, key string, rank_score int, fit int, category string, themes array<string>, head string, pr boolean, readable boolean, event int"
    df = spark.createDataFrame([tuple(x.values()) for x in rows], kinds).repartition(7)
    quotas = editions.Quotas({"m": 3}, {"t": 1}, {"w": 2, "x": 1}, same, count=10, per_head=4)
    for least, fill in ((30, True), (None, False)):
        got = {}
        for x in editions.edition(df, ["day"], quotas, least, fill).orderBy("place").collect():
            got.setdefault(x.day, []).append(x.key)
        assert got == {d: filled([x for x in rows if x["day"] == d], quotas, least, fill) for d in ("a", "b", "c", None, "e")}
    assert editions.edition(df.where("false"), ["day"], quotas).count() == 0


def test_rows_at_hand_are_alike_as_columns_say(spark):
    r = random.Random(6)
    words = ["acorn", "acme", "merger", "merge", "deal", "dealing", "the", "42", "bank", "bankers", "plan", "planned", "x"]
    row = lambda: dict(tokens=r.sample(words, r.randint(0, 5)), ents=r.sample(["Acme", "Bank", "Q"], r.randint(0, 2)), action=r.choice(["a", "b"]))
    some = [(row(), row()) for _ in range(600)]
    one = "struct<tokens: array<string>, ents: array<string>, action: string>"
    df = spark.createDataFrame([(k, *(tuple(x.values()) for x in ab)) for k, ab in enumerate(some)], f"k int, a {one}, b {one}")
    got = {x.k for x in df.where(pairs.same_story(F.col("a"), F.col("b"), ["the", "plan"])).collect()}
    same = editions.alike(["the", "plan"])
    assert got == {k for k, (a, b) in enumerate(some) if same(a, b)} and 50 < len(got) < 550


def test_health_and_signals(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    got = spark.createDataFrame([("2026-01-01 23:00:00",), ("2026-01-01 19:00:00",), ("2026-01-01 00:00:00",)], "t string").select(marts.health(F.to_timestamp("t"), now)).collect()
    assert [r[0] for r in got] == ["ok", "warn", "down"]
    picks = spark.createDataFrame([("e", 2, True, "second. more"), ("e", 1, True, "first"), ("e", 3, False, "x")], "edition string, place int, key_issue boolean, why string")
    assert marts.key_signals(picks, "edition", F.split("why", r"\. ")[0]).first().signals == ["first", "second"]


def test_order_dependent_queries_match_plain_loops(spark):
    from tidewire.plans import relations

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in S.described(spark, sf).select("doc_id", "tokens", "ents", "action", "coverage").collect()}
    df = spark.createDataFrame([(k, r.tokens, r.ents, r.action) for k, r in rows.items()], "doc_id long, tokens array<string>, ents array<string>, action string")
    every = df.select(F.struct("*").alias("a")).crossJoin(df.select(F.struct("*").alias("b"))).where("a.doc_id < b.doc_id")
    like = {(x.a.doc_id, x.b.doc_id) for x in every.where(pairs.same_story(F.col("a"), F.col("b"), S.GENERIC)).collect()}
    kept, want = [], {}
    for k in sorted(rows, key=lambda k: (-rows[k].coverage, k)):
        hit = [q for q in kept if (min(k, q), max(k, q)) in like]
        want[k] = hit[0] if hit else k
        if not hit:
            kept.append(k)
    assert {r.doc_id: r.leader for r in relations.fold_by_event(spark, sf).collect()} == want


def test_every_query_has_unique_columns_and_sql_names_exist():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 60


def test_newest_row_before_matches_a_plain_loop(spark):

    r = random.Random(4)
    rows = [(k, r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice([None, *range(0, 4 * 86400, 3600)])) for k in range(150)]
    table = spark.createDataFrame(rows, "key int, cluster string, s long").selectExpr("key", "cluster", "timestamp_seconds(s) AS ts")
    got = {x.key: x.seen.key if x.seen else None for x in pairs.newest_before(table, table, "cluster", 86400).collect()}
    want = {k: max(((t, j) for j, d, t in rows if d == c and c is not None and None not in (s, t) and t < s <= t + 86400), default=(0, None))[1] for k, c, s in rows}
    assert got == want


def test_budget_keeps_the_rest_for_later(spark):
    rows = spark.createDataFrame([(1, "wiki", 9), (2, "gov x", 1), (3, None, 5), (4, "gov wiki", 9), (5, "news", None), (6, "b", 7)], "key int, hint string, s long").selectExpr("key", "hint", "timestamp_seconds(s) AS ts", "'d' AS day")
    tier = routing.priority(F.col("hint"), ["gov", "news"], ["wiki"])
    out = routing.within_budget(rows.withColumn("tier", tier), "day", 4, routing.queue_order(F.col("tier"), F.col("ts"))).collect()
    assert {x.key: x.tier for x in out} == {1: 2, 2: 0, 3: 1, 4: 2, 5: 0, 6: 1} and {x.key for x in out if x.taken} == {2, 5, 6, 3}


def test_shared_titles_are_those_of_the_rule_on_all_pairs(spark, tmp_path):
    """Long and short words, copies, empty titles, titles with a word and its beginning; rows are read once and no sets are compared."""
    r = random.Random(7)
    some = ["ab", "abc", "abcd", "abx", "ac", "acute", "b", "ba", "bank", "banks", "bar", "éa", "éab", "漢字", "漢字x", "zeta", "zoo", "of"]
    titles = [r.sample(some, r.choice([0, 1, 2, 3, 5])) for _ in range(12)] + [["ab", "abc"], ["ab", "abc"], ["zeta"]]
    rows = [(f"k{k}", r.sample(some + ["q1", "q2", "q3"], r.choice([0, 1, 2, 4, 7, 10]))) for k in range(150)] + [("twice", ["abz", "q1"]), ("twice", ["abc", "acute"])]
    spark.createDataFrame(rows, "key string, tokens array<string>").write.parquet(f"{tmp_path}/rows")
    a, b = spark.read.parquet(f"{tmp_path}/rows"), spark.createDataFrame([(t,) for t in titles], "tokens array<string>")
    for least, stems in ((0.30, 3), (0.8, 2)):
        rule = (T.jaccard(F.col("a.tokens"), F.col("b.tokens")) >= least) | (T.stem_hits(F.col("a.tokens"), F.col("b.tokens")) >= stems)
        expected = {x.key for x in a.alias("a").crossJoin(b.alias("b")).where(rule).select("a.key").distinct().collect()}
        got = pairs.shared_titles(a, b, jaccard=least, stems=stems)
        assert sorted(x.key for x in got.collect()) == sorted(expected) and 0 < len(expected) < 150
        assert not any("/rows/" in f for f in got.inputFiles())
        assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.shared_titles(a, b.limit(0)).collect() == [] and pairs.shared_titles(a.limit(0), b).collect() == []
