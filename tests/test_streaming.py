import random

from pyspark.sql import functions as F

from tidewire.operators import pairs
from tidewire.streaming import events, flows

SCHEMA = "key string, url_key string, published_at timestamp, tokens array<string>"


def landed(spark, path, parts):
    rows = [(f"k{k % 30}", f"u{k % 30}", 1700000000 + k * 600, [f"w{k % 5}", f"w{k % 5}x"]) for k in range(60)]
    df = spark.createDataFrame(rows, "key string, url_key string, t long, tokens array<string>").withColumn("published_at", F.timestamp_seconds("t")).drop("t")
    df.select("key", "url_key", "published_at", "tokens").repartition(parts).write.mode("append").parquet(path)


def test_one_batch_and_many_give_one_ledger(spark, tmp_path):
    seen = {}
    for parts, per_batch in ((1, None), (6, 1)):
        base = f"{tmp_path}/{parts}"
        landed(spark, f"{base}/in", parts)
        emitted = []
        for _ in range(2):  # the second run finds nothing new
            q = flows.into_ledger(flows.landing(spark, f"{base}/in", SCHEMA, per_batch), f"{base}/ledger", "key", f"{base}/cp", lambda df, n: emitted.extend(r.key for r in df.collect()))
            q.awaitTermination()
        ledger = [r.key for r in spark.read.parquet(f"{base}/ledger").collect()]
        assert sorted(ledger) == sorted(set(ledger)) == sorted(emitted)
        seen[parts] = set(ledger)
    assert seen[1] == seen[6] == {f"k{k}" for k in range(30)}


def test_a_batch_run_again_emits_once(spark, tmp_path):
    path, emitted = f"{tmp_path}/ledger", []
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "key string, t long").withColumn("published_at", F.timestamp_seconds("t"))
    more = batch.union(spark.createDataFrame([("c", 9)], "key string, t long").withColumn("published_at", F.timestamp_seconds("t")))

    def fails(df, number):
        raise OSError("lost")

    emit = lambda df, n: emitted.extend((n, r.key) for r in df.collect())
    for k, df in ((0, batch), (0, batch), (1, more), (1, more)):
        try:
            flows.ledger_batch(df, k, path, "key", fails)
        except OSError:
            pass
        flows.ledger_batch(df, k, path, "key", emit)
    assert sorted(emitted) == [(0, "a"), (0, "b"), (1, "c")]
    assert sorted(r.key for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_warm_up_emits_nothing(spark, tmp_path):
    landed(spark, f"{tmp_path}/in", 1)
    emitted = []
    flows.into_ledger(flows.landing(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/ledger", "key", f"{tmp_path}/cp", lambda df, n: emitted.append(n), warm_up=True).awaitTermination()
    assert emitted == [] and spark.read.parquet(f"{tmp_path}/ledger").count() == 30


def test_windows_and_dedup(spark, tmp_path):
    landed(spark, f"{tmp_path}/in", 2)
    stream = flows.landing(spark, f"{tmp_path}/in", SCHEMA)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert len(run(flows.deduplicated(flows.dated(stream, "2024-01-01")), "deduped")) == 30
    assert sum(r.n for r in run(flows.hourly(stream, ["url_key"]), "hours", "complete")) == 60


GENERIC = ["the", "plan"]
DAY = 86400


def event_items(r, n):
    words = ["acorn", "merger", "deal", "bank", "court", "fraud", "rates", "bonds", "leak", "audit", "fund", "the", "plan", "42"]
    rows = []
    for k in range(n):
        tokens, ents = r.sample(words, r.randint(1, 5)), r.sample(["Acme", "Bank", "Quay", "Reef"], r.choice([0, 0, 1, 2]))
        at = 1_700_000_000 + k * 7200
        rows.append(dict(block=r.choice(["x", "x", "y"]), key=f"k{k:04}", fp=f"{'+'.join(sorted(ents))}|{r.randrange(40)}", ts=at, tokens=tokens, ents=ents, action=r.choice("ab"), bucket=at // 259200, rank=[r.randrange(9), r.randrange(3), 0, 0, r.randrange(50)]))
    return rows


def plain_index(rows, days=10):
    """The loop over all items of a block, in order."""
    compare, known, out = events.likeness(GENERIC), {}, []
    for x in sorted(rows, key=lambda x: (x["ts"], x["key"])):
        own = {c: v for c, v in known.items() if c[0] == x["block"] and x["ts"] - v["last"] <= days * DAY}
        c = (x["block"], x["fp"]) if (x["block"], x["fp"]) in own else None
        if c is None:
            found = sorted((-j, c) for c, v in own.items() for j, same in [compare(x, v)] if same)
            c = found[0][1] if found else None
        new = c is None
        c = c or (x["block"], x["fp"])
        if new or x["rank"] > known[c]["rank"]:
            known[c] = {**x, "last": x["ts"]}
        known[c]["last"] = max(known[c]["last"], x["ts"])
        out.append((x["block"], c[1], x["key"], new, known[c]["key"]))
    return sorted(out)


def run_index(spark, path, rows, files, name, days=10):
    df = spark.createDataFrame([tuple(x.values()) for x in rows], events.ITEM.replace("ts timestamp", "at long")).select("block", "key", "fp", F.timestamp_seconds("at").alias("ts"), "tokens", "ents", "action", "bucket", "rank")
    per = -(-len(rows) // files)
    for k in range(files):
        keys = [x["key"] for x in rows[k * per : (k + 1) * per]]
        df.where(F.col("key").isin(keys)).coalesce(1).write.mode("append").parquet(path)
    stream = flows.landing(spark, path, events.ITEM, 1)
    q = events.event_index(stream, GENERIC, days).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(x) for x in spark.table(name).collect()), q.recentProgress


def test_the_event_index_is_the_same_in_two_batches_and_in_ten(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    events.use_rocksdb(spark)
    try:
        rows = event_items(random.Random(8), 120)
        expected = plain_index(rows)
        assert sum(x[3] for x in expected) not in (0, 120) and any(x[2] != x[4] and not x[3] for x in expected)
        for files in (2, 10):
            found, _ = run_index(spark, f"{tmp_path}/{files}", rows, files, f"index{files}")
            assert found == expected
        # A block that goes quiet: once the watermark is past its last item by the days, its state is gone.
        late = [{**x, "block": "z", "ts": x["ts"] + 40 * DAY, "bucket": x["bucket"] + 13} for x in rows[-4:]]
        late = [{**x, "key": f"z{k}", "ts": x["ts"] + k * 10 * DAY} for k, x in enumerate(late)]
        _, progress = run_index(spark, f"{tmp_path}/idle", rows[:40] + late, 11, "idle", days=1)
        assert progress[-1].stateOperators[0].numRowsTotal < max(p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_items_at_hand_are_events_as_columns_say(spark):
    r = random.Random(9)
    items = event_items(r, 300)
    some = [(r.choice(items), r.choice(items)) for _ in range(800)]
    one = "struct<tokens: array<string>, ents: array<string>, action: string, bucket: long>"
    pick = lambda x: (x["tokens"], x["ents"], x["action"], x["bucket"])
    df = spark.createDataFrame([(k, pick(a), pick(b)) for k, (a, b) in enumerate(some)], f"k int, a {one}, b {one}")
    from tidewire.functions import text as T

    rule = pairs.same_event(F.col("a"), F.col("b"), GENERIC) | (T.jaccard(F.col("a.tokens"), F.col("b.tokens")) >= 0.62)
    got, compare = {x.k for x in df.where(rule).collect()}, events.likeness(GENERIC)
    assert got == {k for k, (a, b) in enumerate(some) if compare(a, b)[1]} and 20 < len(got) < 780


def test_two_limits_of_lateness_in_one_stream(spark, tmp_path):
    arrived = 1_700_000_000
    hours = {"fresh": 23, "old": 25, "rule-fresh": 71, "rule-old": 73}
    rows = [(k, "KR/rules" if k.startswith("rule") else "KR", arrived - h * 3600, arrived) for k, h in hours.items()] + [("undated", "KR", None, arrived), ("again", "KR", arrived, arrived)]
    # In the second file all arrive two days later; the watermark has moved, undated rows and slow ones still come in.
    more = [(f"{k}2", hint, at and at + 2 * DAY, a + 2 * DAY) for k, hint, at, a in rows if k != "again"] + [("again", "KR", arrived + 3600, arrived + 2 * 3600)]
    for part in (rows, more):
        df = spark.createDataFrame(part, "key string, hint string, p long, a long")
        df.select("key", "hint", F.timestamp_seconds("p").alias("published_at"), F.timestamp_seconds("a").alias("arrived_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    from tidewire.functions import times

    stream = flows.landing(spark, f"{tmp_path}/in", "key string, hint string, published_at timestamp, arrived_at timestamp", 1)
    marked = flows.with_lateness(stream, times.age_limit_hours(F.col("hint"), "/rules"))
    for q in flows.split_by_lateness(marked, "key", 72, f"{tmp_path}/main", f"{tmp_path}/side", f"{tmp_path}/cp"):
        q.awaitTermination()
    main, side = (sorted(r.key for r in spark.read.parquet(f"{tmp_path}/{t}").collect()) for t in ("main", "side"))
    assert main == sorted(["fresh", "rule-fresh", "undated", "again", "fresh2", "rule-fresh2", "undated2"])
    assert side == sorted(["old", "rule-old", "old2", "rule-old2"])


def test_a_replay_has_one_effect(spark, tmp_path):
    ledger, emitted = f"{tmp_path}/ledger", []
    rows = spark.createDataFrame([("a", 100), ("b", 200), ("b", 300), ("c", 400), ("out", 9000), ("d", 500)], "key string, t long").withColumn("published_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")))
    flows.ledger_batch(rows.where("key = 'c'"), 0, ledger, "key")
    published = rows.where("key = 'a'").select("key")
    emit = lambda df, n: emitted.extend(r.key for r in df.collect())
    for _ in range(2):
        number = flows.replay(rows, "2023-11-14 22:13:20", "2023-11-14 22:33:20", F.col("key") != "d", ledger, "key", published, emit)
    assert emitted == ["b"] and sorted(r.key for r in spark.read.parquet(ledger).collect()) == ["b", "c"]
    assert number < 0 and flows.replay(rows, "2023-11-14 22:13:20", "2023-11-14 22:34:20", F.lit(False), ledger, "key") != number


def test_drafts_of_slots_in_any_order(spark):
    from itertools import permutations

    from tidewire.operators import ledgers

    at = lambda h: 1_700_006_400 + h * 3600
    built = spark.createDataFrame([("e", [f"k{s}"], q, at(h), s) for s, q, h in ((12, 3.0, -12), (18, 5.0, -6), (22, 5.0, -2), (4, 4.0, 4))], "edition string, keys array<string>, quality double, t long, slot int").withColumn("built_at", F.timestamp_seconds("t")).drop("t")
    for order in list(permutations((12, 18, 22, 4)))[::5]:
        versions = built.where("false")
        for slot in (*order, order[0]):
            versions = ledgers.merged_drafts(versions, built.where(F.col("slot") == slot))
        assert versions.count() == 4 and ledgers.champions(versions).first()["keys"] == ["k18"]
    hours = [(h, (3, 4, 11, 12, 21, 23)[k]) for k, h in enumerate((22, 4, 4, 12, 18, 22))]
    clock = spark.createDataFrame([(want, 1_700_006_400 + (h - 9) * 3600) for want, h in hours], "want int, t long")
    assert clock.where(ledgers.slot_of(F.timestamp_seconds("t")) != F.col("want")).count() == 0
