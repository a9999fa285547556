"""Texts for readers."""

from pyspark.sql import functions as F

from tidewire.functions import assembly as A
from tidewire.functions import rules as R
from tidewire.sources import feeds

FORM = A.Form()


def one(spark, **columns):
    row = spark.range(1)
    return row.select(*(c.alias(k) for k, c in columns.items())).first()


def test_pieces(spark):
    none, lit = F.lit(None).cast("string"), F.lit
    got = one(
        spark, icon=A.icon(lit("⚖️ Rules of law"), FORM), bare=A.icon(none, FORM), name=A.topic_name(lit("⚖️ Rules of law"), lit("x")), unknown=A.topic_name(none, lit("ma")), repost=A.is_repost(lit("TG:a")), own=A.is_repost(none),
        handle=A.origin(none, lit("@who"), lit("X"), FORM), named=A.origin(lit("http://o"), lit("who"), none, FORM), empty=A.origin(none, lit(" "), none, FORM), at=A.posted_label(F.timestamp_seconds(lit(0))), never=A.posted_label(F.lit(None).cast("timestamp")),
        cut=A.one_line(lit("one  two\nthree"), 10), whole=A.one_line(lit("abcdefghijkl"), 5), shown=A.shown_length(lit("<b>a&amp;b</b>&lt;")),
    )
    assert (got.icon, got.bare, got.name, got.unknown, got.repost, got.own) == ("⚖️", "📰", "Rules of law", "ma", True, False)
    assert (tuple(got.handle), tuple(got.named), tuple(got.empty)) == (("@who", "https://x.com/who"), ("who", "http://o"), ("original", ""))
    assert (got.at, got.never, got.cut, got.whole, got.shown) == ("1970-01-01 09:00 KST", "", "one two…", "abcde…", 4)


def test_an_article_in_full_and_under_a_picture(spark):
    none, lit = F.lit(None).cast("string"), F.lit
    source = A.source_line(lit('http://a/?x="1"'), lit("Out & In"), lit(False), A.origin(none, none, none, FORM), FORM)
    full = lambda caption: A.article(lit("A <b>"), lit("✅ lede"), F.array(lit("p & q")), lit("💡 🐧 because"), lit("🔁 news"), lit("now"), source, lit("#x"), lit("🏢"), FORM, caption)
    got = one(spark, full=full(None), caption=full(lit(True)))
    head, rest = "🏢 <b>A &lt;b&gt;</b>\n\n", "✅ <b>Core</b>\nlede\n\n📂 <b>Details</b>\n<blockquote>• p &amp; q</blockquote>\n\n🐧 because\n\n🔁 <b>New facts</b>\nnews\n\n"
    line = '<a href="http://a/?x=&quot;1&quot;">Original article</a> - Out &amp; In\n\n#x'
    assert got.full == "<b>tidewire</b>\n\n" + head + rest + "🕒 now\n\n" + line
    assert got.caption == "<b>tidewire</b>\n\n" + rest + line


def test_a_stored_text_under_its_topic(spark):
    text = "<b>tidewire</b>\n\n🏢 <b>Head</b>\n\n✅ <b>Core</b>\nx\n\n<a href=\"http://r/1?a=1&amp;b\">Original article</a>"
    rows = spark.createDataFrame([(text, "http://r/1?a=1&b", "http://real/1"), (text.replace("🏢 <b>Head</b>", '🏢 <a href="u">x</a>'), "http://q", ""), ("plain", "http://q", None)], "t string, u string, r string")
    got = [r[0] for r in rows.select(A.stored_entry(F.col("t"), F.lit("M&A"), F.col("u") == "http://q", F.col("u"), F.col("r"), FORM)).collect()]
    assert got[0] == '<b>[M&amp;A]</b>\n\n🏢 <a href="http://real/1"><b>Head</b></a>\n\n✅ <b>Core</b>\nx\n\n<a href="http://real/1">Original article</a>'
    assert got[1].startswith('<b>[M&amp;A]</b> · promotion\n\n🏢 <a href="u">x</a>\n\n✅ <b>Core</b>')
    assert got[2] == "<b>[M&amp;A]</b> · promotion\n\nplain"


def test_messages_hold_whole_entries(spark):
    entries = [("e", k, f"<b>{k}</b> " + "x" * n) for k, n in enumerate((10, 10, 50, 3, 3))] + [("f", 0, "y" * 99)]
    df = spark.createDataFrame(entries, "edition string, place int, entry string")
    got = {}
    for r in A.messages(df, ["edition"], 30).orderBy("edition", "part").collect():
        got.setdefault(r.edition, []).append(r.text)
    e = [x[2] for x in entries]
    assert got == {"e": [f"{e[0]}\n\n{e[1]}", e[2], f"{e[3]}\n\n{e[4]}"], "f": [e[5]]}
    headed = [r.text for r in A.messages(df.where("edition = 'e'").withColumn("h", F.lit("head")), ["edition"], 30, F.col("h")).orderBy("part").collect()]
    assert headed == [f"head\n\n{e[0]}", e[1], e[2], f"{e[3]}\n\n{e[4]}"]
    link = spark.range(1).select(A.link_entry(F.lit(2), F.lit(" H "), F.lit(""), F.lit("http://a?b&c"), F.lit("<blockquote>• p</blockquote>"))).first()[0]
    assert link == '<b>2.</b> <a href="http://a?b&amp;c"><b>H</b></a>\n<blockquote>• p</blockquote>\n<a href="http://a?b&amp;c">http://a?b&amp;c</a>'


def test_urgent_items_and_categories(spark):
    rules = R.RuleSet(urgency=(R.Rule("FOMC", "fomc|rate (cut|hike)"), R.Rule("CPI", "cpi")))
    routing = R.UrgentRouting(home="US|Fed", home_tab="home", other_tab="world", mirror_tab="issues", always_mirrored=("FOMC",), deep=("FOMC",))
    lane = lambda *rows: spark.createDataFrame(list(rows), "title string, hint string")
    found = feeds.urgent_lane(lane(("US CPI 3.1", None)), lane(("Jobs", "urgent:jobs/JP"), ("Jobs", None)), lane(("Chair speaks", "x")), lane(("Rate cut soon", "EU"), ("US cpi up", None), ("Nothing", "US")), rules, routing)
    got = sorted((r.precedence, r.title, r.label, r.hint, r.tab, r.mirror, r.deep) for r in found.fillna("").collect())
    assert got == [
        (0, "US CPI 3.1", "release", "", "home", "issues", False), (1, "Jobs", "jobs", "urgent:jobs/JP", "world", "", False), (1, "Jobs", "release", "", "world", "", False),
        (2, "Chair speaks", "speech", "x", "home", "issues", True), (3, "Rate cut soon", "FOMC", "EU/urgent:FOMC", "world", "issues", True), (3, "US cpi up", "CPI", "urgent:CPI", "home", "issues", False),
    ]
    names = spark.createDataFrame([("US Policy",), (" us policy",), ("policy us",), ("odd",), ("",), (None,)], "x string")
    assert [r[0] for r in names.select(R.normal_category(F.col("x"), ["US Policy", "issues"], {"policy us": "US Policy"}, "issues")).collect()] == ["US Policy"] * 3 + ["issues"] * 3
