"""Queries over landed payloads: each is written from the tables as its source would send it, and read back by the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import assembly, judgments, published, times
from tidewire.functions import rules as R
from tidewire.functions import text as T
from tidewire.operators import clusters, marts, routing
from tidewire.plans import sample as S
from tidewire.sources import feeds, pages

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark, sf_dir: str) -> DataFrame:
    """Items with n, the length of their text, from which the odd cases follow."""
    return S.items(spark, sf_dir).withColumn("n", F.length("body"))


ITEMS = f"{S.ITEMS}, i AS (SELECT *, length(body) AS n FROM items)"
ESC = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


def _joined(rows: DataFrame, by: list[Column], piece: Column, size: int, before: str = "", after: str = "", between: str = "") -> DataFrame:
    """by, payload: the pieces of `size` items after each other, in order."""
    page = F.floor(F.col("doc_id") / size).alias("page")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", piece.alias("x")))), lambda s: s["x"]), between)
    return rows.groupBy(page, *by).agg(F.concat(F.lit(before), text, F.lit(after)).alias("payload"))


_ID = lambda: F.col("doc_id").cast("string")


# Collectors


@query(f"""WITH {ITEMS}, c AS (SELECT doc_id, 'CPI ' || source AS event, CASE WHEN n % 3 <> 0 THEN n || '%' END AS actual, n % 4 AS importance, epoch // 60 * 60 AS moment FROM i)
 SELECT doc_id::VARCHAR AS id, event, actual, importance::INT AS importance, moment, importance >= 2 AND actual IS NOT NULL AND (contains(lower(event), 'src1') OR contains(lower(event), 'src4')) AND doc_id % 120 - 20 BETWEEN -5 AND 45 AS fresh FROM c""")
def calendar_releases(spark, sf_dir):
    """Calendar tables of 50 rows a page, and which of their rows are news at a moment of their own."""
    rows = _items(spark, sf_dir)
    day = lambda pattern: F.date_format("ts", pattern)
    actual = F.when(F.col("n") % 3 != 0, F.concat(F.lit('<td id="actual"><span>'), F.col("n").cast("string"), F.lit("%</span></td>"))).otherwise("")
    row = F.concat(F.lit('<tr data-id="'), _ID(), F.lit('" data-country="us" data-event="CPI '), F.col("source"), F.lit('" data-importance="'), (F.col("n") % 4).cast("string"), F.lit('"><td>'), day("yyyy-MM-dd"), F.lit("</td><td>"), day("hh:mm a"), F.lit("</td>"), actual, F.lit("</tr>"))
    found = feeds.calendar_rows(_joined(rows, [], row, 50, "<table>", "</table>").select(F.lit("u").alias("url"), F.col("payload").alias("html")))
    found = clusters.staged(found)
    now = F.timestamp_seconds(F.unix_timestamp("at") + (F.col("id").cast("long") % 120 - 20) * 60)
    fresh = feeds.fresh_releases(found, now, ["src1", "SRC4"]).select("id", F.lit(True).alias("fresh"))
    return found.join(fresh, "id", "left").select("id", "event", "actual", "importance", F.unix_timestamp("at").alias("moment"), F.coalesce("fresh", F.lit(False)).alias("fresh"))


@query(f"""WITH {ITEMS} SELECT doc_id::VARCHAR AS unique_id, title, 'https://example.com/' || lang || '#' || doc_id AS url, CASE WHEN source = 'src1' THEN 'rates' WHEN contains(source, 'src2') THEN 'equity' ELSE 'other' END AS label, epoch AS moment FROM i WHERE n % 4 >= 1""")
def stream_news(spark, sf_dir):
    rows = _items(spark, sf_dir)
    category = F.when(F.col("source") == "src1", "Interest Rate").otherwise(F.col("source"))
    news = rows.select(F.col("doc_id").alias("id"), "title", F.col("body").alias("description"), F.concat(F.lit("https://example.com/"), "lang").alias("url"), category.alias("category"), (F.col("n") % 4).alias("importance"), F.col("ts").cast("string").alias("date"))
    return feeds.stream_items(news, {"interest": "rates", "src2": "equity"}).select("unique_id", "title", "url", "label", F.unix_timestamp("published_at").alias("moment"))


@query(f"""WITH {ITEMS}, p AS (SELECT *, trim(regexp_replace({ESC.format("title")}, '\\s+', ' ', 'g')) AS para FROM i WHERE 1706745600 - epoch <= 3000 * 3600)
 SELECT doc_id, CASE WHEN n % 3 = 0 OR (n % 3 = 1 AND length(para) <= 60) OR contains(para, 'Thth') THEN lang ELSE substr(CASE WHEN n % 3 = 2 AND length(para) > 60 THEN para || chr(10) || para || ' again and again' WHEN n % 3 = 2 AND length(para) + 16 > 60 THEN para || ' again and again' WHEN n % 3 = 2 THEN lang ELSE para END, 1, 300) END AS body FROM p""")
def speeches(spark, sf_dir):
    """Feed rows with the long paragraphs of their pages, where they have one and it isn't boilerplate."""
    rows, para = _items(spark, sf_dir), F.concat(F.lit("<p>"), assembly.escaped(F.col("title")), F.lit("</p>"))
    feed = rows.select("doc_id", F.concat(F.lit("u"), _ID()).alias("url"), F.col("lang").alias("body"), F.col("ts").alias("published_at"))
    second = F.when(F.col("n") % 3 == 2, F.concat(F.lit("<p>short</p><p>"), assembly.escaped(F.col("title")), F.lit(" again <b>and again</b></p>"))).otherwise("")
    landed = rows.where("n % 3 <> 0").select(F.concat(F.lit("u"), _ID()).alias("url"), F.concat(para, second).alias("html"))
    return feeds.speech_items(feed, landed, F.timestamp_seconds(F.lit(1706745600)), ["Thth"], hours=3000, most=300).select("doc_id", "body")


@query(f"""WITH {ITEMS} SELECT lang AS channel, doc_id AS id, title || chr(10) || source AS text, CASE WHEN n % 2 = 0 THEN 'https://example.com/' || doc_id END AS link, epoch AS moment FROM i""")
def channel_pages(spark, sf_dir):
    """Pages of a channel's messages, with references in their texts and inner and outer links."""
    rows = _items(spark, sf_dir)
    outer = F.when(F.col("n") % 2 == 0, F.concat(F.lit('<a href="https://example.com/'), _ID(), F.lit('">more</a>'))).otherwise("")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    message = F.concat(F.lit('<div class="message" data-post="c/'), _ID(), F.lit('"><time datetime="'), stamp, F.lit('"></time><div class="text">'), assembly.escaped(F.col("title")), F.lit("<br/>"), F.col("source"), F.lit('</div><a href="https://t.me/c">in</a>'), outer, F.lit("</div>"))
    found = feeds.channel_messages(_joined(rows, [F.col("lang").alias("channel")], message, 60).select("channel", F.col("payload").alias("html")))
    return found.select("channel", "id", "text", F.try_element_at("links", F.lit(1)).alias("link"), F.unix_timestamp("at").alias("moment"))


@query(f"""WITH {ITEMS}, f AS (SELECT *, doc_id // 100 AS file FROM i) SELECT 'https://example.com/?id=' || doc_id AS loc FROM f WHERE file > (SELECT max(file) FROM f) - 3 AND strftime(ts, '%Y-%m-%d') = (SELECT strftime(max(ts) - INTERVAL 3 HOUR, '%Y-%m-%d') FROM i)""")
def sitemap_day(spark, sf_dir):
    """Addresses of one day from the three newest sitemaps."""
    rows = _items(spark, sf_dir)
    entry = F.concat(F.lit("<url><loc>https://example.com/?id="), _ID(), F.lit("</loc><lastmod>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</lastmod></url>"))
    day = rows.agg(F.date_format(F.timestamp_seconds(F.unix_timestamp(F.max("ts")) - 3 * 3600), "yyyy-MM-dd")).first()[0]
    files = _joined(rows, [], entry, 100).select(F.concat(F.lit("sitemap-"), F.col("page").cast("string"), F.lit(".xml")).alias("name"), "payload")
    return feeds.sitemap_rows(files, day).select("loc")


@query(f"""WITH {ITEMS}, w AS (SELECT *, title || ' ' || source || ' ' || lang AS t FROM i) SELECT doc_id::VARCHAR AS unique_id, title, source || ' ' || lang AS body, array_to_string(list_filter(['src1', 'THE'], lambda x: contains(lower(t), lower(x))), ',') AS found FROM w WHERE contains(t, 'src1') OR contains(lower(t), 'the')""")
def posts_found(spark, sf_dir):
    rows = _items(spark, sf_dir)
    landed = rows.select(F.col("doc_id").alias("id"), F.lit("https://example.com").alias("link"), F.concat(F.lit("<b>"), assembly.escaped(F.col("title")), F.lit("</b>")).alias("title"), F.concat(F.lit("<p>"), "source", F.lit("</p> "), "lang").alias("content"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"))
    return feeds.posts(landed, ["src1", "THE"], "c").select("unique_id", "title", "body", F.array_join("found", ",").alias("found"))


@query(f"""WITH {ITEMS} SELECT 'nested' AS kind, 'c' || doc_id AS unique_id, title, lang AS body, epoch AS moment FROM i UNION ALL SELECT 'flat', 'https://example.com/' || doc_id, title, lang || ' · ' || source, epoch - 32400 FROM i""")
def exchange_notices(spark, sf_dir):
    """Notices of two exchanges, as nested catalogs with times in milliseconds and as a flat list with local times."""
    rows = _items(spark, sf_dir)
    article = F.struct(F.col("doc_id").alias("id"), F.concat(F.lit("c"), _ID()).alias("code"), "title", (F.unix_timestamp("ts") * 1000).alias("releaseDate"))
    catalogs = rows.groupBy(F.floor(F.col("doc_id") / 50).alias("page"), "lang").agg(F.collect_list(article).alias("articles")).select(F.lit("x").alias("source"), F.to_json(F.struct(F.struct(F.array(F.struct(F.col("lang").alias("catalogName"), "articles")).alias("catalogs")).alias("data"))).alias("payload"))
    notice = F.struct(F.array("lang", "source").alias("categories"), "title", F.concat(F.lit("https://example.com/"), _ID()).alias("pc_url"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("published_at"))
    flat = rows.groupBy(F.floor(F.col("doc_id") / 50).alias("page")).agg(F.to_json(F.collect_list(notice)).alias("payload")).select(F.lit("y").alias("source"), "payload")
    columns = lambda df, kind: df.select(F.lit(kind).alias("kind"), "unique_id", "title", "body", F.unix_timestamp("published_at").alias("moment"))
    return columns(feeds.catalog_notices(catalogs, "https://example.com/"), "nested").unionByName(columns(feeds.flat_notices(flat), "flat"))


@query(f"WITH {ITEMS} SELECT 'u' || doc_id AS url, 's' || (doc_id % 10) AS slug, title FROM i UNION ALL SELECT 'u' || doc_id, lang, source FROM i WHERE n % 2 = 0")
def embedded_posts(spark, sf_dir):
    """Objects with a slug and a title at two depths of the data that a page carries."""
    rows = _items(spark, sf_dir)
    inner = F.when(F.col("n") % 2 == 0, F.struct(F.col("lang").alias("slug"), F.col("source").alias("title")))
    data = F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("s"), (F.col("doc_id") % 10).cast("string")).alias("slug"), "title")).alias("list"), F.struct(inner.alias("deep")).alias("more")).alias("props")))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>"))
    return feeds.embedded_items(rows.select(F.concat(F.lit("u"), _ID()).alias("url"), html.alias("html"))).select("url", "slug", "title")


@query(f"WITH {ITEMS} SELECT 'r' || doc_id AS url, 'https://example.com/' || doc_id AS target FROM i WHERE n % 5 <> 0")
def resolved_targets(spark, sf_dir):
    rows = _items(spark, sf_dir)
    target = F.when(F.col("n") % 5 != 0, F.concat(F.lit("https://example.com/"), _ID())).otherwise("none")
    cell = F.to_json(F.array(F.lit("garturlres"), F.lit("https://news.redirect.com/1"), target))
    reply = F.concat(F.lit(")]}'\n\n"), F.to_json(F.array(F.array(F.lit("wrb.fr"), cell))))
    return feeds.resolver_targets(rows.select(F.concat(F.lit("r"), _ID()).alias("url"), reply.alias("reply")), "redirect.com").select("url", "target")


@query(f"""WITH {ITEMS}, l AS (SELECT 0 AS precedence, 'https://example.com/' || doc_id AS value FROM i WHERE n % 4 > 1), t AS (SELECT 1 AS precedence, trim(regexp_replace(title, ' [-/|] .*$', '')) AS value FROM i WHERE n % 3 > 0 AND NOT contains(title, '-') AND NOT contains(title, '|') AND NOT contains(title, '/') AND NOT contains(title, ':'))
 SELECT precedence::INT AS precedence, value FROM (SELECT * FROM l UNION ALL SELECT * FROM t WHERE value <> '')""")
def curated_lists(spark, sf_dir):
    """A list of addresses with comments and blanks, and known titles with tails; the order of sources is kept as precedence."""
    rows = _items(spark, sf_dir)
    line = F.when(F.col("n") % 4 == 0, "# note").when(F.col("n") % 4 == 1, "  ").otherwise(F.concat(F.lit(" https://example.com/"), _ID()))
    plain = rows.where(~F.col("title").rlike("[-|/:]"))
    titles = plain.select((F.col("n") % 3 > 0).alias("ok"), F.concat("title", F.lit(" - Outlet")).alias("title"))
    return feeds.all_sources([feeds.listed_urls(rows.select(line.alias("value"))).withColumnRenamed("url", "value"), feeds.truth_titles(titles).withColumnRenamed("title", "value")]).select("precedence", "value")


# Pages


@query(f"""WITH {ITEMS} SELECT doc_id, CASE WHEN n % 7 = 6 OR epoch > 1706745600 THEN NULL WHEN n % 7 IN (1, 3, 5) THEN epoch // 60 * 60 - 32400 ELSE epoch END AS moment, CASE WHEN n % 7 = 2 THEN 'paywall' WHEN n < 400 THEN 'short' END AS why FROM i WHERE n % 7 = 6 OR epoch <= 1706700000 OR epoch > 1706800000""")
def page_times(spark, sf_dir):
    """The times of pages from six places, with and without a zone, and why a page's text can't be used."""
    rows = _items(spark, sf_dir).where("n % 7 = 6 OR unix_timestamp(ts) <= 1706700000 OR unix_timestamp(ts) > 1706800000")
    zoned, local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    forms = [
        F.concat(F.lit('<meta property="article:published_time" content="'), zoned, F.lit('">')), F.concat(F.lit('<script>{"datePublished": "'), local, F.lit('"}</script>')), F.concat(F.lit('<time datetime="'), zoned, F.lit('">')),
        F.concat(F.lit('<meta itemprop="datePublished" content="'), local, F.lit('">')), F.concat(F.lit('<meta name="date" content="'), zoned, F.lit('">')), F.concat(F.lit("<p>Input "), F.date_format("ts", "yyyy.MM.dd HH:mm"), F.lit("</p>")), F.lit("<p>no time</p>"),
    ]
    html = F.element_at(F.array(*forms), (F.col("n") % 7 + 1).cast("int"))
    url = F.when(F.col("n") % 7 == 2, "https://pay.com/x").otherwise("https://free.com/x")
    at = pages.published_time(html, F.timestamp_seconds(F.lit(1706745600)))
    return rows.select("doc_id", F.unix_timestamp(at).alias("moment"), pages.readable(F.col("n"), url, ["pay.com"]).alias("why"))


@query(f"""WITH {ITEMS}, p AS (SELECT *, {ESC.format("title")} AS head FROM i)
 SELECT doc_id, CASE WHEN n % 2 = 0 THEN source END AS lede, CASE WHEN n % 2 = 0 THEN head || '|' || lang ELSE '' END AS bullets, CASE WHEN n % 3 = 0 THEN lang || ' matters' END AS why, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') || ' KST' AS moment, source, trim(head) AS headline, lang AS tags FROM p WHERE trim(title) <> '' AND NOT contains(title, '•')""")
def published_parts(spark, sf_dir):
    """Texts as they were published, read back into their parts by the present and by the older form."""
    form, even = assembly.Form(), F.col("n") % 2 == 0
    rows = _items(spark, sf_dir).where("trim(title) <> '' AND NOT contains(title, '•')")
    none, no = F.lit(None).cast("string"), F.lit(False)
    origin = assembly.origin(none, none, none, form)
    source = assembly.source_line(F.lit("https://example.com"), F.col("source"), no, origin, form)
    why = F.when(F.col("n") % 3 == 0, F.concat("lang", F.lit(" matters")))
    text = assembly.article(F.col("title"), F.when(even, F.col("source")), F.when(even, F.array("title", "lang")), why, none, assembly.posted_label(F.col("ts")), source, F.concat(F.lit("#"), "lang"), F.lit("📰"), form)
    read = rows.withColumn("text", text).select("doc_id", published.sections(F.col("text")).alias("s"), published.older_parts(F.col("text")).alias("o"))
    return read.select("doc_id", "s.lede", F.array_join("s.bullets", "|").alias("bullets"), "s.why", F.col("s.at").alias("moment"), "s.source", "o.headline", F.array_join("o.tags", ",").alias("tags"))


# Words, times and rules of single items


@query(f"""WITH {ITEMS}, t AS (SELECT *, list_filter(string_split(trim(regexp_replace(regexp_replace(title, '[^\\p{{L}}\\p{{N}} ]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1) AS ws FROM i)
 SELECT doc_id, array_to_string(ws[1:6], ' ') AS term, (length(title) + 1 + length(source))::INT AS visible, trim(regexp_replace(replace(replace(title, 'the', ''), 'que', ''), '\\s+', ' ', 'g')) AS scrubbed, array_to_string(list_filter(['The', 'src1', 'und'], lambda x: contains(lower(title || source), lower(x))), ',') AS matched,
  regexp_matches(' ' || title || ' ', '[^A-Za-z0-9]is[^A-Za-z0-9]') AS acronym, array_to_string([source, lang], ',') AS queries, title || chr(10) || source AS plain FROM t""")
def text_forms(spark, sf_dir):
    rows = _items(spark, sf_dir)
    title, source = F.col("title"), F.col("source")
    markup = F.concat(F.lit("<b>"), assembly.escaped(title), F.lit("</b><br/>"), source)
    queries = published.queries_without_age(F.array(F.concat(source, F.lit(" when:7d")), source, F.concat(F.lit("when:12h "), "lang")))
    return rows.select(
        "doc_id", T.keywords(title).alias("term"), T.visible_length(markup).alias("visible"), T.scrub(title, ["the", "que"]).alias("scrubbed"), F.array_join(T.matched(F.concat(title, source), ["The", "src1", "und"]), ",").alias("matched"),
        title.rlike(T.acronym("is")).alias("acronym"), F.array_join(queries, ",").alias("queries"), T.plain(markup).alias("plain"),
    )


_TIER = f"CASE {S.category()} WHEN 'trade' THEN 1 ELSE CASE WHEN action = 'deal' THEN 2 WHEN action = 'regulation' THEN 3 WHEN list_contains(ents, 'Thanea') THEN 4 ELSE 5 END END"
_THEMES = ", ".join(f"CASE WHEN {S.fits(chr(34) + 'title' + chr(34), r.pattern)} THEN {S._q(r.name)} END" for r in S.RULES.scores if r.name in S.RULES.theme_caps)


@query(f"""WITH {S.DESCRIBED}, f AS (SELECT *, length(body) AS n, {_TIER} AS tier, action IN ('deal', 'regulation') OR material AS decisive, {S.fits("title || ' ' || lang", S.RULES.incident)} AS incident FROM described)
 SELECT doc_id, tier::INT AS tier, decisive, incident OR (n % 2 = 0 AND n % 101 >= 85 AND decisive) AS key_issue, array_to_string(list_filter([{_THEMES}], lambda x: x IS NOT NULL), ',') AS themes, epoch // 259200 AS bucket, n % 5 > 0 AND epoch >= 1704240000 AS dated, CASE WHEN n % 3 = 0 THEN epoch WHEN n % 3 = 1 THEN epoch END AS read FROM f""")
def item_facts(spark, sf_dir):
    """Tier, decisiveness, key issue, themes, bucket and repaired times of items; the action stands for their type."""
    rows = S.described(spark, sf_dir).withColumn("n", F.length("body"))
    title = F.col("title")
    types = {"deal": "purchase", "partnership": "signup", "regulation": "error", "market": "view", "product": "click"}
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in types.items() for x in kv)), F.col("action"))
    decisive = R.is_decisive(title, kind, S.RULES)
    tier = R.tier(title, F.lit("none"), F.array_join("ents", ","), kind, S.RULES, "trade", [], [])
    key = judgments.is_key_issue(R.is_incident(title, F.col("lang"), S.RULES), F.col("n") % 2 == 0, F.col("n") % 101, decisive)
    seconds = F.unix_timestamp("ts")
    given = F.when(F.col("n") % 3 == 0, seconds.cast("string")).when(F.col("n") % 3 == 1, (seconds * 1000).cast("string")).otherwise("soon")
    return rows.select(
        "doc_id", tier.alias("tier"), decisive.alias("decisive"), key.alias("key_issue"), F.array_join(R.themes(title, F.lit(""), S.RULES), ",").alias("themes"), times.event_bucket(F.col("ts")).alias("bucket"),
        times.dated_since(F.when(F.col("n") % 5 > 0, F.col("ts")), F.timestamp_seconds(F.lit(1704240000))).alias("dated"), F.unix_timestamp(times.epoch(given)).alias("read"),
    )


# Reports


@query(f"""WITH {S.LOG}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, max(ts) AS last FROM log GROUP BY 1), e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY score DESC, key) AS place FROM log),
 s AS (SELECT day, array_to_string(list(key::VARCHAR ORDER BY place), ',') AS signals FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY place) AS rn FROM e WHERE action = 'deal') WHERE rn <= 5 GROUP BY 1),
 h AS (SELECT day, (floor(epoch(strptime(day, '%Y-%m-%d'))) + 86400 - floor(epoch(last))) / 3600 AS age FROM d)
 SELECT day, CASE WHEN age < 2 THEN 'ok' WHEN age < 6 THEN 'warn' ELSE 'down' END AS health, coalesce(signals, '') AS signals FROM h LEFT JOIN s USING (day)""")
def day_reports(spark, sf_dir):
    """Each day's health at its end, and the keys of its first five deals as signals."""
    log = S.log(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    end = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp("day")) + 86400)
    last = log.groupBy("day").agg(F.max("ts").alias("last")).select("day", marts.health(F.col("last"), end).alias("health"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.col("score").desc(), "key"))
    picks = log.withColumns({"place": place, "key_issue": F.col("action") == "deal"})
    signals = marts.key_signals(picks, "day", F.col("key").cast("string"))
    return last.join(signals, "day", "left").select("day", "health", F.coalesce(F.array_join("signals", ","), F.lit("")).alias("signals"))


@query(f"""WITH {S.LOG}, l AS (SELECT key FROM log WHERE score < 5), m AS (SELECT key, action, CASE WHEN k % 7 = 0 THEN 'other' ELSE action END AS topic, k % 11 = 0 AS mirrored FROM log)
 SELECT finding, count(*) AS n FROM (SELECT key, 'duplicate' AS finding FROM m WHERE key IN (SELECT key FROM l) UNION ALL SELECT key, 'topic' FROM m WHERE topic <> action UNION ALL SELECT key, 'mirrored' FROM m WHERE mirrored) GROUP BY 1""")
def health_findings(spark, sf_dir):
    """Duplicates, topics that differ from their category and mirrored rows, written as a mart and read again."""
    log = S.log(spark, sf_dir)
    rows = log.select("key", "action", F.when(F.col("k") % 7 == 0, "other").otherwise(F.col("action")).alias("topic"), (F.col("k") % 11 == 0).alias("mirrored"))
    found = routing.findings(rows, log.where("score < 5").select(F.col("key").alias("loser")), F.col("action"))
    folder = clusters.stage_path(spark)
    routing.write_marts({"findings": found}, folder)
    return spark.read.schema("key long, finding string").json(f"{folder}/findings").groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.DESCRIBED} SELECT source, day, doc_id FROM (SELECT source, strftime(ts, '%Y-%m-%d') AS day, doc_id, row_number() OVER (PARTITION BY source, strftime(ts, '%Y-%m-%d') ORDER BY coverage DESC, doc_id) AS rn FROM described) WHERE rn = 1")
def widest_of_batch(spark, sf_dir):
    """Of each source and day, a batch, the item that covers most."""
    rows = S.described(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return clusters.best_of(rows, [F.col("source"), F.col("day")], [F.col("coverage").desc(), F.col("doc_id")]).select("source", "day", "doc_id")
