"""Queries over the curated flow as a whole: editions day after day, replays, drafts, sources by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import assembly, published
from tidewire.functions import rules as R
from tidewire.functions import text as T
from tidewire.operators import clusters, edition_run, editions, ledgers, pairs, routing
from tidewire.plans import sample as S
from tidewire.sources import feeds
from tidewire.streaming import flows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Editions


def _policy(fill_days: int = 0) -> edition_run.Policy:
    same = {"same": editions.alike(S.GENERIC), "same_strict": editions.alike(S.GENERIC, strict=True)}
    return edition_run.Policy(caps=S.RULES.category_caps, theme_caps=S.RULES.theme_caps, floors=S.RULES.category_floors, fill_days=fill_days, **same)


def _candidates(spark, sf_dir: str) -> DataFrame:
    """Items with all that an edition judges. Those labelled of low quality were published before, titles of benchmark were shared."""
    rows = edition_run.slotted(S.described(spark, sf_dir))
    title, ents = F.col("title"), F.array_join("ents", ",")
    labels = S.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("__q")).distinct()
    benchmark = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), T.tokens(F.split(F.split("text", "\n")[0], r"\. ")[0], S.STOP).alias("tokens"))
    tier = R.tier(title, F.lit(None).cast("string"), ents, F.lit(None).cast("string"), S.RULES, "trade", [], [])
    fit = R.score(title, F.lit(""), None, S.RULES)
    rows = rows.withColumns({
        "cluster": clusters.fingerprint(F.col("ents"), F.col("tokens"), F.col("action"), F.col("bucket")), "fit": fit.cast("int"), "score": (fit + R.risk_bonus(title, S.RULES)).cast("int"), "bonus": R.tier_bonus(tier),
        "category": R.primary_category(title, S.RULES), "head": F.coalesce(F.try_element_at("ents", F.lit(1)), F.lit("_")), "pr": R.is_promotion(title, S.RULES), "technical": R.is_technical(title, S.RULES),
        "readable": F.length("body") >= 200, "fresh": F.col("material"), "fact": R.is_material(title, None, S.RULES, strict=True),
        "themes": R.themes(title, ents, S.RULES), "issues": R.hits(F.concat_ws(" ", title, ents), S.ISSUES), "articles": F.array(F.sha2("body", 256)),
        "origin": F.when(F.length("body") % 11 != 0, F.unix_timestamp("ts") - F.length("body") % 30 * 3600),
    })
    # Texts are read once, and nothing from here on carries them.
    rows = clusters.staged(rows.drop("body", "title", "source", "lang", "material", "bucket").join(labels, "doc_id", "left").drop("doc_id"))
    shared = clusters.staged(pairs.shared_titles(rows.select("key", "tokens"), benchmark).withColumn("__shared", F.lit(True)))
    clusters.release(spark)
    facts = ["tokens", "ents", "action"]
    blocks = clusters.staged(pairs.story_blocks(rows.select("key", "edition", *facts, "__q"), S.GENERIC))
    before = blocks.where("__q = 0").withColumn("edition", F.col("edition") + 1)
    told = pairs.like_known(blocks, before, lambda a, b: pairs.same_story(a, b, S.GENERIC, strict=True), ["ents", "telling", "rare"], facts, equal=("edition",)).withColumn("__told", F.lit(True))
    clusters.drop_staged(blocks)
    no = F.lit(False)
    rows = rows.join(shared, "key", "left").join(told, "key", "left").withColumns({"shared": F.coalesce("__shared", no), "published": F.coalesce("__told", no)})
    words = edition_run.repeated(rows.where("__q = 0").select("edition", "until", "ts", "telling"), ["edition"], _policy())
    return edition_run.with_running(rows, words, ["edition"]).withColumn("ts", F.unix_timestamp("ts"))


@query()
def edition_days(spark, sf_dir):
    """The editions of all days, each knowing those before it: order-dependent, so without SQL; tests hold the whole job against a plain loop."""
    policy = _policy(fill_days=1)
    groups = edition_run.grouped(_candidates(spark, sf_dir), ["edition"], lambda a, b: pairs.same_story(a, b, S.GENERIC), S.GENERIC, policy.fill_days)
    return edition_run.run(edition_run.offers(groups, ["edition"], policy), ["edition"], policy).select("edition", "place", "key", "phase", "pr")


# Sources


def _escaped(text):
    for raw, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(reference))
    return text


@query(f"""WITH {S.ITEMS}, r AS (SELECT *, 'https://example.com/' || (doc_id // 3) AS link, length(body) % 5 = 2 AS broken FROM items WHERE epoch > 1704153600 AND epoch <= 1717200000 AND length(body) % 13 <> 5)
 SELECT link AS unique_id, trim(regexp_replace(title, '<[^>]*>', '', 'g')) AS title, epoch AS published, source, broken FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY doc_id) AS rn FROM r) WHERE rn = 1""")
def search_found(spark, sf_dir):
    """Search replies of 40 results each, read from raw XML: titles in CDATA or with references, broken items, undated ones, links that come again, dates of two zones."""
    rows = S.items(spark, sf_dir).withColumn("n", F.length("body"))
    text = F.col("title")
    cdata = F.concat(F.lit("<![CDATA["), text, F.lit("]]>"))
    title = F.when((F.col("n") % 2 == 0) & ~F.contains(text, F.lit("]]>")), cdata).otherwise(_escaped(text))
    at = lambda zone: F.date_format(F.from_utc_timestamp("ts", zone), "EEE, dd MMM yyyy HH:mm:ss")
    date = F.when(F.col("n") % 3 == 0, F.concat(at("Asia/Seoul"), F.lit(" +0900"))).otherwise(F.concat(at("UTC"), F.lit(" GMT")))
    dated = F.when(F.col("n") % 13 == 5, F.lit("<pubDate>soon</pubDate>")).otherwise(F.concat(F.lit("<pubDate>"), date, F.lit("</pubDate>")))
    tail = F.when(F.col("n") % 5 == 2, F.lit("<description>a <b>bold</description>")).otherwise(F.lit("<description>a &lt;b&gt;bold&lt;/b&gt; line</description>"))
    link = F.concat(F.lit("<link>https://example.com/"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("</link>"))
    source = F.concat(F.lit('<source url="https://example.com/">'), F.col("source"), F.lit("</source>"))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title>"), link, dated, source, tail, F.lit("</item>"))
    reply = F.floor(F.col("doc_id") / 40)
    replies = rows.groupBy(reply.alias("arrival")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))), lambda s: s["x"]), "\n").alias("items"))
    replies = replies.select(F.lit("q").alias("query"), "arrival", F.concat(F.lit("<rss><channel><title>q</title>"), "items", F.lit("</channel></rss>")).alias("xml"))
    found = feeds.search_results(replies, F.timestamp_seconds(F.lit(1704153600)), F.timestamp_seconds(F.lit(1717200000)))
    return found.select("unique_id", "title", F.unix_timestamp("published_at").alias("published"), "source", "broken")


@query(f"""WITH {S.ITEMS}, l AS (SELECT *, CASE WHEN lang = 'en' THEN 'wire' ELSE 'world' END AS folder FROM items), r AS (SELECT *, row_number() OVER (PARTITION BY source, folder ORDER BY doc_id) AS rn FROM l)
 SELECT CASE folder WHEN 'wire' THEN 'Wire' ELSE 'World' END AS source, CASE folder WHEN 'wire' THEN 'home' ELSE 'abroad' END AS region, trim(title) AS title, doc_id::VARCHAR AS unique_id FROM r WHERE rn <= 15""")
def landed_by_source(spark, sf_dir):
    """Feeds landed in two folders, read in one go; a dimension table names the source of each folder."""
    rows = S.items(spark, sf_dir).withColumn("folder", F.when(F.col("lang") == "en", "wire").otherwise("world"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "folder").orderBy("doc_id"))).where("place <= 15")
    id_ = F.col("doc_id").cast("string")
    item = F.concat(F.lit("<item><title>"), _escaped(F.col("title")), F.lit("</title><link>https://example.com/"), id_, F.lit("</link><guid>"), id_, F.lit("</guid></item>"))
    payloads = rows.groupBy("folder", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))), lambda s: s["x"]), " ").alias("value"))
    base = clusters.stage_path(spark)
    for folder in ("wire", "world"):
        # A file for each feed: the source's name parts them.
        payloads.where(F.col("folder") == folder).select("source", "value").write.partitionBy("source").text(f"{base}/{folder}")
    named = spark.createDataFrame([("wire", "Wire", "home"), ("world", "World", "abroad")], "folder string, source string, region string")
    landed = feeds.landed_feeds(spark, [f"{base}/wire", f"{base}/world"], named, up=1)
    return feeds.feed_items(landed.withColumn("source", F.concat_ws("|", "source", "region", "path"))).select(F.split("source", r"\|")[0].alias("source"), F.split("source", r"\|")[1].alias("region"), "title", "unique_id")


_HOME = "eau|Th"
_URGENT = R.UrgentRouting(home=_HOME, home_tab="home macro", other_tab="world macro", mirror_tab="issues", always_mirrored=("alert",), deep=("alert", "note"))
_URGENCY = "CASE " + " ".join(f"WHEN {S.fits('title', r.pattern)} THEN {S._q(r.name)}" for r in S.RULES.urgency) + " END"


@query(f"""WITH {S.ITEMS}, h AS (SELECT doc_id, title, lang, length(body) % 4 AS lane, CASE lang WHEN 'en' THEN '' ELSE 'rates' END AS named FROM items),
 l AS (SELECT *, CASE lane WHEN 0 THEN 'release' WHEN 1 THEN coalesce(nullif(named, ''), 'release') WHEN 2 THEN 'speech' ELSE {_URGENCY} END AS label, CASE lane WHEN 1 THEN 'urgent:' || named || '/' || lang ELSE lang END AS given FROM h),
 k AS (SELECT *, CASE lane WHEN 3 THEN given || '/urgent:' || label ELSE given END AS hint FROM l WHERE label IS NOT NULL), u AS (SELECT *, regexp_matches(title || ' ' || hint, '{_HOME}') AS home FROM k)
 SELECT doc_id, lane::INT AS precedence, label, hint, CASE WHEN lane = 2 OR home THEN 'home macro' ELSE 'world macro' END AS tab, CASE WHEN lane = 2 OR home OR label = 'alert' THEN 'issues' END AS mirror, lane = 2 OR (lane = 3 AND label IN ('alert', 'note')) AS deep FROM u""")
def urgent_lane(spark, sf_dir):
    """Four sources of urgent items with their labels, tabs and mirrors; which of them an item is from follows from its length."""
    rows = S.items(spark, sf_dir).select("doc_id", "title", "lang", (F.length("body") % 4).alias("lane"))
    plain = rows.withColumn("hint", F.col("lang"))
    stream = rows.withColumn("hint", F.concat(F.lit("urgent:"), F.when(F.col("lang") == "en", "").otherwise("rates"), F.lit("/"), "lang"))
    lane = lambda df, k: df.where(F.col("lane") == k).drop("lane", "lang")
    found = feeds.urgent_lane(lane(plain, 0), lane(stream, 1), lane(plain, 2), lane(plain, 3), S.RULES, _URGENT)
    return found.select("doc_id", "precedence", "label", "hint", "tab", "mirror", "deep")


# Publishing


@query(f"""WITH {S.ITEMS}, s AS (SELECT *, {S.score()} AS fit, CASE WHEN length(body) % 9 <> 0 THEN epoch END AS dated FROM items)
 SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY dated ASC NULLS LAST, key)::INT AS turn FROM s WHERE fit >= 20""")
def posts_in_order(spark, sf_dir):
    """Items that fit what readers share, in the order in which each source's are published: oldest first, undated last."""
    rows = S.items(spark, sf_dir).withColumns({"fit": R.score(F.col("title"), F.lit(""), None, S.RULES), "at": F.when(F.length("body") % 9 != 0, F.col("ts"))})
    turn = F.row_number().over(Window.partitionBy("source").orderBy(*routing.publish_order(F.col("at"))))
    return rows.where(R.fit_to_post(F.col("fit"))).select("doc_id", turn.alias("turn"))


_CATEGORIES, _ALIASES = ["src1", "Src2", "SRC3"], {"src4": "src1", "feed 5": "Src2"}


@query("""WITH r AS (SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN NULL WHEN source = 'src5' THEN ' Feed 5' WHEN length(text) % 2 = 0 THEN upper(source) || ' ' ELSE source END AS raw FROM documents)
 SELECT doc_id, CASE WHEN raw IN ('src1', 'Src2', 'SRC3') THEN raw ELSE CASE lower(trim(raw)) WHEN 'src1' THEN 'src1' WHEN 'src2' THEN 'Src2' WHEN 'src3' THEN 'SRC3' WHEN 'src4' THEN 'src1' WHEN 'feed 5' THEN 'Src2' ELSE 'other' END END AS category FROM r""")
def legacy_categories(spark, sf_dir):
    """Categories of the older table in one spelling."""
    n = F.length("text")
    source = F.when(F.col("source") == "src5", " Feed 5").when(n % 2 == 0, F.concat(F.upper("source"), F.lit(" "))).otherwise(F.col("source"))
    return S.table(spark, sf_dir, "documents").select("doc_id", R.normal_category(F.when(n % 7 != 0, source), _CATEGORIES, _ALIASES, "other").alias("category"))


_ESC = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@query(f"""WITH {S.ITEMS}, p AS (SELECT *, length(body) % 3 = 0 AS repost, length(body) % 2 = 0 AS even, {_ESC.format("title")} AS head, 'https://example.com/?a=1&b=' || doc_id AS url FROM items)
 SELECT doc_id, '<b>tidewire</b>' || chr(10) || chr(10) || CASE lang WHEN 'en' THEN '🏢' ELSE '📰' END || ' <b>' || head || '</b>' || chr(10) || chr(10)
  || CASE WHEN even THEN '✅ <b>Core</b>' || chr(10) || {_ESC.format("trim(source)")} || chr(10) || chr(10) || '📂 <b>Details</b>' || chr(10) || '<blockquote>• ' || head || chr(10) || '• ' || lang || '</blockquote>' || chr(10) || chr(10) ELSE '' END
  || '🕒 ' || strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') || ' KST' || chr(10) || chr(10)
  || CASE WHEN repost AND even THEN '📎 Source: <a href="https://x.com/' || source || '">@' || source || '</a>' WHEN repost THEN '📎 Source: original' ELSE '<a href="' || {_ESC.format("url")} || '">Original article</a> - ' || source END
  || chr(10) || chr(10) || '#' || lang AS text FROM p""")
def article_texts(spark, sf_dir):
    """Items as texts for readers: headline, core and details where there are any, time, source line (reposts name their origin), tag."""
    form, even = assembly.Form(), F.length("body") % 2 == 0
    landed = F.when(F.length("body") % 3 == 0, F.concat(F.lit("TG:"), "source")).otherwise(F.col("source"))
    url = F.concat(F.lit("https://example.com/?a=1&b="), F.col("doc_id").cast("string"))
    origin = assembly.origin(F.lit(None).cast("string"), F.when(even, F.concat(F.lit("@"), "source")), F.when(even, "X"), form)
    label = published.source_label(F.col("source"), r"^feed:[^(]*\((.+)\)$", ["US"], ["policy"])
    source = assembly.source_line(url, label, assembly.is_repost(landed), origin, form)
    icon = assembly.icon(F.when(F.col("lang") == "en", "🏢 Group"), form)
    points, none = F.when(even, F.array("title", "lang")), F.lit(None).cast("string")
    text = assembly.article(F.col("title"), F.when(even, F.col("source")), points, none, F.lit(""), assembly.posted_label(F.col("ts")), source, F.concat(F.lit("#"), "lang"), icon, form)
    return S.items(spark, sf_dir).select("doc_id", text.alias("text"))


# Replays and drafts


_NEAR = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(near), {S._q(a.lower())})' for a in (n, *al))} THEN {S._q(n)} END" for names in S.RULES.aliases.values() for n, al in names.items())


@query(f"""WITH {S.ITEMS}, m AS (SELECT *, list_filter([{_NEAR}], lambda x: x IS NOT NULL) AS named FROM (SELECT *, title || ' ' || substr(body, 1, 300) AS near FROM items)),
 g AS (SELECT doc_id FROM m WHERE {S.reason()} IS NULL AND len(named) > 0 AND epoch > 1704070800 AND epoch <= 1735689600)
 SELECT doc_id FROM g WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def replayed(spark, sf_dir):
    """A past interval run again through the relaxed gate into a ledger, twice, with one effect; what was published stays out."""
    rows = S.items(spark, sf_dir).withColumnRenamed("ts", "published_at")
    kept = R.gate(F.col("title"), F.col("body"), S.RULES, relaxed=True).isNull()
    out = rows.join(S.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi").select("key")
    ledger = clusters.stage_path(spark)
    for _ in range(2):
        number = flows.replay(rows.select("doc_id", "key", "title", "body", "published_at"), "2024-01-01 01:00:00", "2025-01-01 00:00:00", kept, ledger, "key", published=out)
    return spark.read.parquet(f"{ledger}/batch={number}").select("doc_id")


@query(f"""WITH {S.LOG}, s AS (SELECT strftime(ts, '%Y-%m-%d') AS edition, unnest([4, 12, 18, 22]) AS slot, ts, score, key FROM log WHERE score >= 60), i AS (SELECT * FROM s WHERE hour(ts) < slot),
 q AS (SELECT edition, slot, count(*) * 1000 + avg(score) + greatest(0, 1 - avg(slot - hour(ts)) / 48) AS quality, min(key) AS first FROM i GROUP BY 1, 2)
 SELECT edition, slot::INT AS slot, first::VARCHAR AS keys FROM (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY quality DESC, slot) AS rn FROM q) WHERE rn = 1""")
def draft_slots(spark, sf_dir):
    """Each day's drafts of four slots, of what had come by then, merged in the wrong order and one of them twice: the best stands, the earliest of equals."""
    log = S.log(spark, sf_dir).where("score >= 60").withColumn("edition", F.date_format("ts", "yyyy-MM-dd"))
    every = log.withColumn("slot", F.explode(F.array(*map(F.lit, (4, 12, 18, 22))))).where(F.hour("ts") < F.col("slot"))
    every = every.withColumns({"fit": F.col("score"), "age_hours": (F.col("slot") - F.hour("ts")).cast("double")})
    built = ledgers.quality(every, ["edition", "slot"]).join(every.groupBy("edition", "slot").agg(F.array(F.min("key").cast("string")).alias("keys")), ["edition", "slot"])
    built = clusters.staged(built.withColumn("built_at", F.timestamp_seconds(F.unix_timestamp(F.to_timestamp("edition")) + F.col("slot") * 3600)))
    versions = built.where("slot = 18")
    for slot in (22, 4, 18, 12):
        versions = ledgers.merged_drafts(versions, built.where(F.col("slot") == slot))
    best = ledgers.champions(versions)
    return best.select("edition", ledgers.slot_of(F.col("built_at"), zone="UTC").alias("slot"), F.element_at("keys", 1).alias("keys"))


# Texts of editions


_TEXTS = f"""{S.LOG}, e AS (SELECT strftime(ts, '%Y-%m-%d') AS edition, key, action, score, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY score DESC, key) AS place FROM log WHERE score >= 65)"""


@query(f"""WITH {_TEXTS}, t AS (SELECT *, '<b>' || place || '. ' || CASE action WHEN 'deal' THEN '🤝' ELSE '📰' END || ' [' || CASE action WHEN 'deal' THEN 'Deals' ELSE action END || ']</b>' || chr(10) || '<a href="https://example.com/' || key || '?a&amp;b">Item &lt;' || key || '&gt;</a>'
  || CASE WHEN key % 2 = 0 THEN chr(10) || chr(10) || '<b>Core</b>  ' || action || ' of ' || score ELSE '' END || CASE WHEN key % 3 = 0 THEN chr(10) || '🐧 ' || 'why' ELSE '' END || chr(10) AS entry FROM e WHERE place <= 10),
 s AS (SELECT edition, list(action ORDER BY place) AS signals FROM e WHERE place <= 2 AND action = 'deal' GROUP BY 1)
 SELECT edition, '☀️ <b>tidewire | Brief</b>' || chr(10) || chr(10) || edition || chr(10) || chr(10) || string_agg(entry, chr(10) ORDER BY place) || CASE WHEN len(any_value(signals)) > 0 THEN chr(10) || '━━━━━━━━━━━━━━' || chr(10) || chr(10) || '🚨 <b>Key signals</b>' || chr(10) || chr(10) || array_to_string(list_transform(any_value(signals), lambda x: '• ' || x), chr(10)) ELSE '' END AS text
 FROM t LEFT JOIN s USING (edition) GROUP BY edition""")
def edition_texts(spark, sf_dir):
    """Each day's ten best as one text, with its deals among the first two as signals."""
    form, key = assembly.Form(), F.col("key").cast("string")
    rows = S.log(spark, sf_dir).where("score >= 65").withColumn("edition", F.date_format("ts", "yyyy-MM-dd"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("edition").orderBy(F.col("score").desc(), "key"))).where("place <= 10")
    name = F.when(F.col("action") == "deal", "🤝 Deals")
    lede = F.when(F.col("key") % 2 == 0, F.concat("action", F.lit("  of "), F.col("score").cast("string")))
    entry = assembly.edition_entry(F.col("place"), F.concat(F.lit("Item <"), key, F.lit(">")), F.concat(F.lit("https://example.com/"), key, F.lit("?a&b")), lede, F.when(F.col("key") % 3 == 0, "why"), assembly.icon(name, form), assembly.topic_name(name, F.col("action")), form)
    signals = rows.where("place <= 2 AND action = 'deal'").groupBy("edition").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "action"))), lambda s: s["action"]).alias("signals"))
    return assembly.edition(rows.select("edition", F.col("edition").alias("label"), "place", entry.alias("entry")), ["edition"], "label", form, "Brief", signals)


@query(f"""WITH {_TEXTS}, d AS (SELECT edition, action, count(*) AS n, list('Item ' || key ORDER BY place) AS points FROM e GROUP BY 1, 2)
 SELECT edition, action, '🗂 <b>' || action || ' · ' || edition || ' digest</b>' || chr(10) || chr(10) || n || ' &gt; 0' || CASE WHEN n % 2 = 0 THEN chr(10) || chr(10) || '<blockquote>' || array_to_string(list_transform(points[1:3], lambda x: '• ' || x), chr(10)) || '</blockquote>' ELSE '' END
  || CASE WHEN n % 3 = 0 THEN chr(10) || chr(10) || '🐧 so' ELSE '' END || chr(10) || chr(10) || '<i>' || n || ' items</i>' AS text FROM d""")
def digest_texts(spark, sf_dir):
    """A digest of each day and category."""
    rows = S.log(spark, sf_dir).where("score >= 65").withColumn("edition", F.date_format("ts", "yyyy-MM-dd"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("edition").orderBy(F.col("score").desc(), "key")))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("edition", "action").orderBy("place"))).withColumn("point", F.when(F.col("rn") <= 3, F.concat(F.lit("Item "), F.col("key").cast("string"))))
    points = F.transform(F.array_sort(F.collect_list(F.when(F.col("point").isNotNull(), F.struct("rn", "point")))), lambda s: s["point"])
    days = first.groupBy("edition", "action").agg(F.count(F.lit(1)).alias("n"), points.alias("points"))
    text = assembly.digest(F.col("action"), F.col("edition"), F.concat(F.col("n").cast("string"), F.lit(" > 0")), F.when(F.col("n") % 2 == 0, F.col("points")), F.when(F.col("n") % 3 == 0, "so"), F.col("n"), assembly.Form())
    return days.select("edition", "action", text.alias("text"))
