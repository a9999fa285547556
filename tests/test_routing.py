from pyspark.sql import functions as F

from tidewire.functions import published as P
from tidewire.operators import routing as G

ROUTES = G.Routing(
    homes={"US Rates": "us", "US Equities": "us", "KR Policy": "kr"}, kinds={"US Rates": "rates", "US Equities": "equities", "KR Policy": "policy"},
    places={("us", "rates"): "US Rates", ("us", "equities"): "US Equities", ("kr", "policy"): "KR Policy", ("kr", "rates"): "KR Rates", ("jp", "policy"): "JP Policy"},
    catch_all={"World Policy": "policy", "Macro": "rates"}, fallback={"rates": "Macro", "equities": "Macro", "policy": "World Policy"}, by_index=("US Equities",),
    countries={"us": ("fed", "america"), "kr": ("korea",), "jp": ("japan",)}, indexes={"us": ("nasdaq",), "kr": ("kospi",)},
)


def test_enforced(spark):
    cases = [
        ("World Policy", "x", "korea says", "KR Policy"), ("Macro", "x", "fed moves", "US Rates"), ("Macro", "x", "japan moves", "Macro"), ("US Rates", "x", "fed and fed, korea", "US Rates"), ("US Rates", "x", "korea korea fed", "KR Rates"),
        ("US Equities", "x", "kospi up as korea gains", "KR Rates"), ("US Equities", "x", "nasdaq korea korea", "US Equities"), ("KR Policy", "x", "america america", "World Policy"), ("KR Policy", "x", "america", "KR Policy"), ("US Rates", "x", "korea fed", "US Rates"),
        ("Other", "x", "korea", "Other"), ("US Rates", "japan", "japan fed japan", "Macro"),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, category string, head string, text string, want string")
    got = df.select("k", G.enforced(F.col("category"), F.col("head"), F.col("text"), ROUTES).alias("g"), "want").orderBy("k").collect()
    assert [r.g for r in got] == [r.want for r in got]


def test_topics_verdicts_and_groups(spark):
    rows = spark.createDataFrame([("a", "focus", ["focus", "x"], "Other firm, focus follows"), ("b", "focus", [], "Focus leads"), ("c", "x", [], "Regulator acts"), ("d", "focus", None, "none")], "key string, topic string, secondary array<string>, title string")
    got = rows.select(G.corrected_topic(F.col("topic"), F.col("secondary"), F.col("title"), "focus", "focus", "other", "Regulator", "rule")).collect()
    assert [r[0] for r in got] == ["x", "focus", "rule", "other"]
    facts = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p")], "key string, category string")
    verdicts = spark.createDataFrame([("a", False, None), ("b", True, "q")], "key string, relevant boolean, category string")
    assert sorted((r.key, r.category, r.moved) for r in G.apply_verdicts(facts, verdicts).collect()) == [("b", "q", True), ("c", "p", False)]
    members = spark.createDataFrame([("g", "a", 9, 1, False), ("g", "b", 5, 2, True), ("g", "c", 5, 3, True)], "leader string, key string, coverage int, score int, readable boolean")
    assert G.first_readable(members).first().key == "c"
    log = spark.createDataFrame([("k", 1, 1000)], "key string, cluster int, t long").withColumn("ts", F.timestamp_seconds("t"))
    new = spark.createDataFrame([("m", 1, 2000), ("n", 1, 200000), ("o", 2, 2000)], "key string, cluster int, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.key for r in G.once_a_day(new, log).collect()} == {"n", "o"}
    checked = spark.createDataFrame([("a", "t", "t", False), ("b", "t", "u", True)], "key string, topic string, want string, mirrored boolean")
    found = G.findings(checked, spark.createDataFrame([("a", "b")], "loser string, winner string"), F.col("want"))
    assert {tuple(r) for r in found.collect()} == {("a", "duplicate"), ("b", "topic"), ("b", "mirrored")}


def test_registration_and_marts(spark, tmp_path):
    old = spark.createDataFrame([("a", 5)], "key string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    new = spark.createDataFrame([("a", 50), ("b", 500)], "key string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    out = G.register(old, new, F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(100)))
    assert sorted((r.key, r.out_of_window) for r in out.collect()) == [("a", False), ("b", True)]
    G.write_marts({"articles": out}, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/articles").count() == 2


def test_published_texts(spark):
    text = "📰 <b>Head</b>\n✅ <b>Core</b>\nThe lede.\n\n<blockquote>• one\n• two</blockquote>\n💡 <b>Why</b>\nBecause.\n\n🕒 10.06 09:00\n<a href='x'>y</a> - Inner (Outlet)\n#tag #other"
    row = spark.createDataFrame([(text,), (None,)], "x string").select(P.sections(F.col("x")).alias("s"), P.older_parts(F.col("x")).alias("o")).collect()
    assert (row[0].s.lede, row[0].s.bullets, row[0].s.why, row[0].s["at"], row[0].s.source) == ("The lede.", ["one", "two"], "Because.", "10.06 09:00", "Outlet")
    assert row[0].o.headline == "Head" and row[0].o.tags == ["tag", "other"] and row[1].s.bullets == [] and row[1].s.lede is None
    missing = spark.range(1).select(P.missing_parts(F.lit("h"), F.lit(" "), F.lit(None), F.array().cast("array<string>"))).first()[0]
    assert missing == ["lede", "comment", "bullets"]
    names = spark.createDataFrame([("feed:US(Bloomberg.com)",), ("Daily (US)",), ("Daily (daily.com)",), ("Daily policy",), (None,)], "x string")
    assert [r[0] for r in names.select(P.source_label(F.col("x"), r"^feed:[^(]*\((.+)\)$", ["US"], ["policy"])).collect()] == ["Bloomberg.com", "Daily", "Daily", "Daily", ""]
    assert spark.range(1).select(P.queries_without_age(F.array(F.lit("bank when:7d"), F.lit("bank"), F.lit("law when:1h x")))).first()[0] == ["bank", "law x"]
