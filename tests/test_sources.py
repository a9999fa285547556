import datetime as dt
import json

from pyspark.sql import functions as F

from tidewire.sources import feeds, pages


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_feed_items(spark):
    rss = "<rss>" + "".join(f"<item><title><![CDATA[T{k} &amp; x]]></title><link>http://a/{k}</link><pubDate>Tue, 06 Oct 2026 09:00:00 +0900</pubDate><description>&lt;p&gt;body&lt;/p&gt;</description></item>" for k in range(20)) + "<item><title>no link</title></item></rss>"
    atom = '<feed><entry><title>E</title><link rel="alternate" href="http://b/1"/><updated>2026-10-06T00:00:00Z</updated><summary>s</summary></entry></feed>'
    got = feeds.feed_items(rows(spark, [("r", rss), ("a", atom)], "source string, payload string")).collect()
    assert len(got) == 16 and {r.title for r in got if r.source == "a"} == {"E"}
    assert {r.published_at for r in got} == {dt.datetime(2026, 10, 6)} and {r.body for r in got if r.source == "r"} == {"body"} and all(r.title.endswith("& x") for r in got if r.source == "r")


def test_calendar_stream_and_speech(spark):
    html = '<table><tr data-id="7" data-country="us" data-event="CPI YoY" data-importance="3"><td>2026-10-06 08:30 AM</td><td id="actual"><span>3.1%</span></td><td id="previous">3.0%</td></tr><tr data-id="8" data-event="Other" data-importance="1"><td>2026-10-06 08:30 AM</td></tr></table>'
    cal = feeds.calendar_rows(rows(spark, [("u", html)], "url string, html string"))
    assert [(r.id, r.event, r.actual, r.forecast, r.importance) for r in cal.orderBy("id").collect()] == [("7", "CPI YoY", "3.1%", None, 3), ("8", "Other", None, None, 1)]
    assert feeds.fresh_releases(cal, F.lit("2026-10-06 09:00:00").cast("timestamp"), ["cpi"]).count() == 1
    assert feeds.fresh_releases(cal, F.lit("2026-10-06 10:00:00").cast("timestamp"), ["cpi"]).count() == 0
    stream = rows(spark, [(1, "t", "d", "http://u", "Stock Market", 2, "2026-10-06 00:00:00"), (2, "t", "d", "http://u", "x", 0, None)], "id long, title string, description string, url string, category string, importance int, date string")
    assert [(r.url, r.label) for r in feeds.stream_items(stream, {"stock": "equity"}).collect()] == [("http://u#1", "equity")]
    feed = rows(spark, [("s", "u1", "short"), ("s", "u2", "kept")], "source string, url string, body string").withColumn("published_at", F.lit("2026-10-06 00:00:00").cast("timestamp"))
    page = rows(spark, [("u1", "<p>" + "long words " * 10 + "</p><p>short</p><p>Subscribe " + "x" * 80 + "</p>")], "url string, html string")
    got = {r.url: r.body for r in feeds.speech_items(feed, page, F.lit("2026-10-06 10:00:00").cast("timestamp"), ["Subscribe"]).collect()}
    assert got == {"u1": ("long words " * 10).strip(), "u2": "kept"}


def test_messages_and_lists(spark):
    html = '<div class="message" data-post="ch/5"><time datetime="2026-10-06T00:00:00+00:00"></time><div class="text">First line<br>second &amp; third, which is long enough</div><a href="https://t.me/x">in</a><a href="https://out.com/1">out</a></div><div class="message" data-post="ch/6"><time datetime="2026-10-06T00:00:00+00:00"></time><div class="text">short</div></div>'
    m = feeds.channel_messages(rows(spark, [("ch", html)], "channel string, html string")).withColumn("page", F.lit(1))
    assert [(r.id, r.links) for r in m.orderBy("id").collect()] == [(5, ["https://out.com/1"]), (6, [])]
    item = feeds.channel_items(m, F.lit("2026-10-05").cast("timestamp")).collect()
    assert [(r.source, r.title, r.url) for r in item] == [("TG:ch", "First line", "https://out.com/1")]
    assert [r.url for r in feeds.listed_urls(rows(spark, [("# c",), (" ",), (" http://a ",)], "value string")).collect()] == ["http://a"]
    assert [r.title for r in feeds.truth_titles(rows(spark, [(True, "A - b"), (False, "C")], "ok boolean, title string")).collect()] == ["A"]
    files = rows(spark, [(f"sitemap{k}.xml", f"<url><loc>http://x/{k}</loc><lastmod>2026-10-0{k}T00:00:00Z</lastmod></url>") for k in range(1, 6)], "name string, payload string")
    assert [r.loc for r in feeds.sitemap_rows(files, "2026-10-05").collect()] == ["http://x/5"]
    assert feeds.all_sources([files.limit(1), files.limit(1)]).select("precedence").distinct().count() == 2


def test_json_sources(spark):
    catalogs = json.dumps({"data": {"catalogs": [{"catalogName": "New", "articles": [{"id": 1, "code": "c1", "title": "T", "releaseDate": 1700000000000}]}]}})
    got = feeds.catalog_notices(rows(spark, [("ex", catalogs)], "source string, payload string"), "http://ex/").first()
    assert (got.unique_id, got.url, got.body) == ("c1", "http://ex/c1", "New")
    flat = json.dumps([{"categories": ["a", "b"], "title": "T", "pc_url": "http://n/1", "published_at": "2026-10-06 09:00:00"}])
    got = feeds.flat_notices(rows(spark, [("ex", flat)], "source string, payload string")).first()
    assert got.body == "a · b" and got.published_at == dt.datetime(2026, 10, 6)
    next_data = '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"posts": [{"title": "A", "slug": "a"}, {"title": "A2", "slug": "a"}, {"x": {"title": "B", "slug": "b"}}]}}) + "</script>"
    assert {(r.slug) for r in feeds.embedded_items(rows(spark, [("u", next_data), ("v", None)], "url string, html string")).collect()} == {"a", "b"}
    reply = "noise\n" + json.dumps([["x", json.dumps(["https://news.redirect.com/1", "https://real.com/1"])]])
    assert feeds.resolver_targets(rows(spark, [("r", reply)], "url string, reply string"), "redirect.com").first().target == "https://real.com/1"
    post = rows(spark, [(1, "http://p", "<b>Coin</b> law", "<p>text</p>", "2026-10-06T00:00:00"), (2, "http://q", "none", "", None)], "id long, link string, title string, content string, date string")
    assert [(r.title, r.found) for r in feeds.posts(post, ["coin", "tax"], "c").collect()] == [("Coin law", ["coin"])]


def test_pages(spark):
    html = '<html><head><title>Head line</title><meta property="og:description" content="Lead &amp; more"><meta property="article:published_time" content="2026-10-06T09:00:00+09:00"></head><body><nav>' + "menu " * 20 + "</nav><article><p>" + "First paragraph. " * 5 + "</p><p>Head line</p><p>tiny</p><p>" + "First paragraph. " * 5 + "</p></article></body></html>"
    df = rows(spark, [("u", html)], "url string, html string")
    got = pages.paragraphs(df).first()
    assert got.body == ("First paragraph. " * 5).strip() and got.n_paras == 1
    now = F.lit("2026-10-07").cast("timestamp")
    meta = df.select(pages.page_title(F.col("html")), pages.description(F.col("html")), pages.published_time(F.col("html"), now), pages.published_time(F.col("html"), F.lit("2026-10-05").cast("timestamp")), pages.readable(F.lit(10), F.col("url"), ["pay.com"])).first()
    assert tuple(meta) == ("Head line", "Lead & more", dt.datetime(2026, 10, 6), None, "short")


def test_every_form_of_clock(spark):
    """A feed's date without a zone is the zone's; a post's without one is UTC; notices are local; calendars have twelve hours; Z and offsets are read."""
    when = ["Tue, 06 Oct 2026 09:00:00 +0900", "Tue, 06 Oct 2026 00:00:00 GMT", "6 Oct 2026 00:00:00 Z", "2026-10-06T00:00:00Z", "2026-10-06T09:00:00+09:00", "2026-10-06 09:00:00", "Tue, 06 Oct 2026 09:00:00"]
    rss = "".join(f"<item><title>t</title><link>http://a/{k}</link><pubDate>{w}</pubDate></item>" for k, w in enumerate(when))
    got = feeds.feed_items(rows(spark, [("r", rss)], "source string, payload string")).collect()
    assert len(got) == 7 and {r.published_at for r in got} == {dt.datetime(2026, 10, 6)}
    late = feeds.feed_items(rows(spark, [("r", "<item><title>t</title><link>http://a/1</link><pubDate>soon</pubDate></item>")], "source string, payload string")).first()
    assert late.published_at is None
    post = feeds.posts(rows(spark, [(1, "http://p", "coin", "", "2026-10-06T00:00:00")], "id long, link string, title string, content string, date string"), ["coin"], "c").first()
    assert post.published_at == dt.datetime(2026, 10, 6)
    clocks = "".join(f'<tr data-id="{k}" data-event="e"><td>2026-10-06</td><td>{c}</td></tr>' for k, c in enumerate(["12:05 AM", "12:05 PM", "9:30 PM"]))
    at = [r["at"] for r in feeds.calendar_rows(rows(spark, [("u", clocks)], "url string, html string")).orderBy("id").collect()]
    assert at == [dt.datetime(2026, 10, 6, 0, 5), dt.datetime(2026, 10, 6, 12, 5), dt.datetime(2026, 10, 6, 21, 30)]


def test_search_results_and_landed_folders(spark, tmp_path):
    good = '<item><title><![CDATA[A & b <i>c</i>]]></title><link>http://a</link><pubDate>Tue, 06 Oct 2026 00:00:01 GMT</pubDate><source url="http://o">Out &amp; In</source><description>&lt;p&gt;body&lt;/p&gt; x</description><guid isPermaLink="false">g</guid></item>'
    broken = "<item><title>C &amp; d</title><link> http://b </link><pubDate>Tue, 06 Oct 2026 09:00:02 +0900</pubDate><description><b>open</description></item>"
    others = "<item><title>no date</title><link>http://c</link></item><item><link>http://d</link><pubDate>Tue, 06 Oct 2026 00:00:03 GMT</pubDate></item><item><title>late</title><link>http://e</link><pubDate>Wed, 07 Oct 2026 00:00:00 GMT</pubDate></item>"
    again = good.replace("A & b", "Again")
    xml = lambda body: f"<rss><channel>{body}</channel></rss>"
    replies = rows(spark, [("q2", 2, xml(again)), ("q", 1, xml(good + broken + others)), ("n", 0, None)], "query string, arrival int, xml string")
    limit = lambda t: F.lit(t).cast("timestamp")
    got = feeds.search_results(replies, limit("2026-10-06"), limit("2026-10-06 12:00:00")).orderBy("url").collect()
    assert [(r.source, r.title, r.url, r.body, r.query, r.broken) for r in got] == [("Out & In", "A & b c", "http://a", "body x", "q", False), ("search", "C & d", "http://b", "open", "q", True)]
    assert [r.published_at.second for r in got] == [1, 2]

    for folder, name in (("x", "1.xml"), ("x", "2.xml"), ("y", "1.xml"), ("z", "1.xml")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(f"<item>\n{folder}{name}</item>")
    dimension = rows(spark, [("x", "Ex", "home"), ("y", "Why", None), ("unused", "U", None)], "folder string, source string, region string")
    landed = feeds.landed_feeds(spark, [f"{tmp_path}/{f}" for f in "xyz"], dimension).collect()
    assert sorted((r.source or "", r.region or "", r.payload) for r in landed) == [("", "", "<item>\nz1.xml</item>"), ("Ex", "home", "<item>\nx1.xml</item>"), ("Ex", "home", "<item>\nx2.xml</item>"), ("Why", "", "<item>\ny1.xml</item>")]


def against_sql(spark, tmp_path, query: str, html: list) -> None:
    """A query over pages gives what its SQL gives in DuckDB."""
    import duckdb

    from tidewire.plans import scalars

    rows(spark, [(k, f"http://u/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = scalars.QUERIES[query](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(scalars.SQL[query]).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 0


ODD_TITLES = ["a &amp;&quot;b&quot; and cut &amp", "a &lt;&nbsp;b &amp;amp; c", " two  blanks\n and a line ", ""]


def test_page_titles_as_in_sql(spark, tmp_path):
    og = '<meta property="og:title" content="Other">'
    against_sql(spark, tmp_path, "page_title", [f"<head>{og}<title>{t}</title></head>" for t in ODD_TITLES] + ['<title lang="en">x</title>', "<TITLE>x</TITLE>", None])


def test_page_paragraphs_as_in_sql(spark, tmp_path):
    """A title's echo goes if it is the title as it stands in the source, with only &amp; decoded."""
    long = ", and more words of the same long line"
    echo = [f"<head><!-- <title>no</title> --><title>{t}{long}</title></head><body><p>{t}{long}</p><p>Another line that is long enough to be kept</p></body>" for t in ODD_TITLES]
    against_sql(spark, tmp_path, "page_paragraphs", echo)
