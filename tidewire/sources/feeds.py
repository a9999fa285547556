"""Landed feeds, messages and notices to items. Payloads come as tables of text; nothing is fetched here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import rules as R
from tidewire.functions import text as T
from tidewire.functions import times

#: Forms of a time without a zone.
LOCAL = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "d MMM yyyy HH:mm:ss"]
ITEM_COLUMNS = ["source", "unique_id", "title", "url", "body", "published_at"]
RFC822 = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z"]  # after the day's name


def _tag(block: Column, name: str) -> Column:
    """The text of an element, CDATA unwrapped."""
    raw = F.regexp_extract(block, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
    return F.trim(F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))


def _blocks(payload: Column, name: str) -> Column:
    return F.regexp_extract_all(payload, F.lit(rf"(?is)<{name}\b.*?</{name}\s*>"), F.lit(0))


def feed_items(payloads: DataFrame, per_feed: int = 15, body: int = 2000, zone: str = "Asia/Seoul") -> DataFrame:
    """RSS items and Atom entries of (source, payload): the first per_feed with a link. A date without a zone is the zone's."""
    entries = payloads.select("source", F.posexplode(F.concat(_blocks(F.col("payload"), "item"), _blocks(F.col("payload"), "entry"))).alias("pos", "block"))
    block = F.col("block")
    link = F.coalesce(F.nullif(_tag(block, "link"), F.lit("")), F.nullif(F.regexp_extract(block, r"""(?i)<link\b[^>]*href=["']([^"']+)""", 1), F.lit("")))
    when = F.coalesce(F.nullif(_tag(block, "pubDate"), F.lit("")), F.nullif(_tag(block, "published"), F.lit("")), F.nullif(_tag(block, "updated"), F.lit("")))
    text = F.coalesce(F.nullif(_tag(block, "description"), F.lit("")), F.nullif(_tag(block, "summary"), F.lit("")), F.lit(""))
    bare = F.regexp_replace(when, r"^[A-Za-z]{3},\s*", "")
    zoned = F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in RFC822), F.try_to_timestamp(when))
    dated = F.when(when.rlike(r"(GMT|UTC|[+-]\d\d:?\d\d|Z)\s*$"), zoned).otherwise(times.local_time(bare, zone, LOCAL))
    items = entries.select("source", "pos", link.alias("url"), T.plain(_tag(block, "title")).alias("title"), F.substring(T.squeeze(T.plain(T.unescape(text))), 1, body).alias("body"), F.coalesce(F.nullif(_tag(block, "guid"), F.lit("")), link).alias("unique_id"), dated.alias("published_at"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("pos"))
    return items.where("url IS NOT NULL").withColumn("place", place).where(F.col("place") <= per_feed).select(*ITEM_COLUMNS)


def search_items(items: DataFrame, noise: list[str], per_query: int = 12, body: int = 1500) -> DataFrame:
    """Search results (query, pos, title, ...) without noise words, "title - outlet" split, the first per_query of a query."""
    clean = items.where(~F.exists(F.array(*map(F.lit, noise)), lambda w: F.contains(F.col("title"), w)) if noise else F.lit(True))
    title, outlet = T.split_outlet(F.col("title"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("pos"))
    return clean.withColumns({"outlet": outlet, "bare": title, "__rn": rank, "body": F.substring("body", 1, body)}).where(F.col("__rn") <= per_query).drop("__rn", "title").withColumnRenamed("bare", "title")


#: The elements of a search result. What an element holds beyond its text is read and left.
RESULT = "title string, link string, pubDate string, description string, source struct<_VALUE: string, _url: string>, __broken string"


def search_results(replies: DataFrame, since: Column, until: Column, body: int = 2000, unnamed: str = "search") -> DataFrame:
    """Results of (query, arrival, xml) with since < published_at <= until, the first arrival of each link: ITEM_COLUMNS, query, broken.

    Each <item> is parsed as XML, with CDATA and character references; one that isn't well-formed is read by patterns, and marked `broken`. A result
    needs a title, a link and an RFC 822 date. Markup is taken out of titles and bodies; a null reply has no results.
    """
    blocks = replies.select("query", "arrival", F.posexplode(_blocks(F.col("xml"), "item")).alias("pos", "block"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken", "attributePrefix": "_", "valueTag": "_VALUE"}
    read = blocks.withColumn("x", F.from_xml("block", RESULT, options))
    # A parsed element has its references decoded; a raw one has them decoded here.
    raw = lambda name: F.when(F.col("block").rlike(rf"(?is)<{name}\b[^>]*>"), T.unescape(_tag(F.col("block"), name)))
    broken = F.col("x.__broken").isNotNull() | F.col("x").isNull()
    of = lambda name, value: F.trim(F.regexp_replace(F.when(broken, raw(name)).otherwise(value), "<[^>]*>", ""))
    when = F.regexp_replace(of("pubDate", F.col("x.pubDate")), r"^[A-Za-z]{3},\s*", "")
    at = F.coalesce(*(F.try_to_timestamp(when, F.lit(f)) for f in RFC822))
    outlet = F.coalesce(F.nullif(of("source", F.col("x.source._VALUE")), F.lit("")), F.lit(unnamed))
    link = of("link", F.col("x.link"))
    items = read.select(
        outlet.alias("source"), link.alias("unique_id"), of("title", F.col("x.title")).alias("title"), link.alias("url"), F.substring(F.coalesce(of("description", F.col("x.description")), F.lit("")), 1, body).alias("body"),
        at.alias("published_at"), "query", broken.alias("broken"), F.struct("arrival", "pos").alias("arrival"),
    )
    return between(items.where("title IS NOT NULL AND unique_id != ''"), since, until).drop("arrival")


def landed_feeds(spark: SparkSession, folders: list[str], sources: DataFrame, up: int = 0) -> DataFrame:
    """(source, region, payload, path) of the files in many folders, in one read: rows meet their source by the folder that their file lies in.

    sources (folder, source, region) names folders; up says how many folders lie between them and their files. The list is the owner's,
    and files of a folder that it doesn't name keep a null source. A file is a payload as a whole.
    """
    files = spark.read.option("recursiveFileLookup", True).text(folders, wholetext=True).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("path"))
    folder = F.element_at(F.split("path", "/"), -2 - up)
    return files.withColumn("folder", folder).join(sources.select("folder", "source", "region"), "folder", "left").select("source", "region", "payload", "path")


def between(items: DataFrame, since: Column, until: Column) -> DataFrame:
    """since < published_at <= until, the first of each unique_id by arrival."""
    kept = items.where(times.in_window(F.col("published_at"), since, until))
    return kept.withColumn("__rn", F.row_number().over(Window.partitionBy("unique_id").orderBy("arrival"))).where("__rn = 1").drop("__rn")


def calendar_rows(pages: DataFrame) -> DataFrame:
    """Rows of an economic calendar's table from (url, html): id, iso, time, event, actual, previous, forecast, importance."""
    row = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*data-id=.*?</tr>"), F.lit(0)))
    at = lambda name: F.regexp_extract("row", rf"""(?i)data-{name}=["']([^"']*)""", 1)
    cell = lambda name: F.nullif(T.squeeze(F.regexp_replace(F.regexp_extract("row", rf"""(?is)<td[^>]*id=["']{name}["'][^>]*>(.*?)</td>""", 1), r"<[^>]*>", "")), F.lit(""))
    clock = F.regexp_extract("row", r"(?i)\b(\d{1,2}:\d{2}\s*[AP]M)\b", 1)
    rows = pages.select("url", row.alias("row"))
    return rows.select("url", at("id").alias("id"), at("country").alias("iso"), F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract("row", r"(\d{4}-\d{2}-\d{2})", 1), clock), F.lit("yyyy-MM-dd h:mm a")).alias("at"), at("event").alias("event"), cell("actual").alias("actual"), cell("previous").alias("previous"), cell("forecast").alias("forecast"), F.coalesce(at("importance").try_cast("int"), F.lit(0)).alias("importance"))


def fresh_releases(rows: DataFrame, now: Column, names: list[str], least: int = 2, before_min: int = 5, after_min: int = 45) -> DataFrame:
    """Releases with a value, important enough, with a listed name, from 5 minutes ahead to 45 old."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("at")) / 60
    named = F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower("event"), F.lower(n)))
    return rows.where((F.col("importance") >= least) & F.col("actual").isNotNull() & age.between(-before_min, after_min) & named)


def stream_items(rows: DataFrame, labels: dict[str, str], least: int = 1, source: str = "stream") -> DataFrame:
    """News rows (id, title, description, url, category, importance, date) as items: labelled by category, a suffix makes each release's URL its own."""
    label = F.coalesce(*(F.when(F.contains(F.lower("category"), F.lit(k)), v) for k, v in labels.items()), F.lit("other"))
    kept = rows.where(F.col("importance") >= least)
    return kept.select(F.lit(source).alias("source"), F.col("id").cast("string").alias("unique_id"), "title", F.concat("url", F.lit("#"), F.col("id").cast("string")).alias("url"), F.col("description").alias("body"), F.to_timestamp("date").alias("published_at"), label.alias("label"))


def speech_items(feed: DataFrame, pages: DataFrame, now: Column, boilerplate: list[str], hours: int = 24, least: int = 60, most: int = 18_000) -> DataFrame:
    """Feed rows of the last hours with their page's paragraphs, long ones without boilerplate, up to `most` characters."""
    paragraphs = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: T.squeeze(F.regexp_replace(p, r"<[^>]*>", "")))
    wanted = F.filter(paragraphs, lambda p: (F.length(p) > least) & ~F.exists(F.array(*map(F.lit, boilerplate)), lambda b: F.contains(p, b)) if boilerplate else F.length(p) > least)
    recent = feed.where(F.unix_timestamp(now) - F.unix_timestamp("published_at") <= hours * 3600)
    return recent.join(pages.select("url", F.substring(F.array_join(wanted, "\n"), 1, most).alias("page_body")), "url", "left").withColumn("body", F.coalesce(F.nullif("page_body", F.lit("")), "body")).drop("page_body")


def channel_messages(pages: DataFrame) -> DataFrame:
    """Messages of public channel pages (channel, html): channel, id, at, text, photos, links (outer ones only)."""
    block = F.explode(F.filter(F.split("html", r'(?=<div class="message")'), lambda b: F.contains(b, F.lit("data-post="))))
    rows = pages.select("channel", block.alias("b"))
    links = F.filter(F.regexp_extract_all("b", F.lit(r"""(?i)<a[^>]*href=["']([^"']+)"""), F.lit(1)), lambda u: ~F.contains(u, F.lit("://t.")))
    return rows.select("channel", F.regexp_extract("b", r'data-post="[^"/]*/(\d+)"', 1).try_cast("long").alias("id"), F.try_to_timestamp(F.regexp_extract("b", r'datetime="([^"]+)"', 1)).alias("at"), T.plain(F.regexp_extract("b", r'(?s)<div class="text">(.*?)</div>', 1)).alias("text"), F.regexp_extract_all("b", F.lit(r"""url\('([^']+)'\)"""), F.lit(1)).alias("photos"), links.alias("links"))


def channel_items(messages: DataFrame, since: Column, least: int = 40, title: int = 120, placeholder: str = "(photo)") -> DataFrame:
    """Messages since a time, the last page's of each id; those without a photo and under `least` characters go."""
    newest = messages.withColumn("__rn", F.row_number().over(Window.partitionBy("channel", "id").orderBy(F.col("page").desc()))).where("__rn = 1").drop("__rn")
    kept = newest.where((F.col("at") >= since) & ((F.size("photos") > 0) | (F.length(F.coalesce("text", F.lit(""))) >= least)))
    line = F.trim(F.split(F.coalesce("text", F.lit("")), "\n")[0])
    return kept.select(F.concat(F.lit("TG:"), "channel").alias("source"), F.col("id").cast("string").alias("unique_id"), F.when(line == "", placeholder).otherwise(F.substring(line, 1, title)).alias("title"), F.coalesce(F.try_element_at("links", F.lit(1)), F.lit("")).alias("url"), F.coalesce("text", F.lit("")).alias("body"), F.col("at").alias("published_at"))


def sitemap_rows(files: DataFrame, day: str, newest: int = 3) -> DataFrame:
    """(loc, lastmod) of a day from the newest sitemap files (name, payload), by the number in their names."""
    last = files.withColumn("n", F.coalesce(F.regexp_extract("name", r"(\d+)\D*$", 1).try_cast("int"), F.lit(0))).orderBy(F.col("n").desc()).limit(newest)
    block = last.select(F.explode(_blocks(F.col("payload"), "url")).alias("b"))
    return block.select(_tag(F.col("b"), "loc").alias("loc"), _tag(F.col("b"), "lastmod").alias("lastmod")).where(F.col("lastmod").startswith(day))


def posts(rows: DataFrame, words: list[str], category: str) -> DataFrame:
    """Posts (id, link, title, content, date: UTC without a zone) that hold any of the words, with those they hold."""
    bare = rows.withColumns({"__title": T.plain(F.col("title")), "__body": T.plain(F.col("content"))})
    out = bare.withColumn("found", T.matched(F.concat_ws(" ", "__title", "__body"), words)).where(F.size("found") > 0)
    return out.select(F.lit("posts").alias("source"), F.col("id").cast("string").alias("unique_id"), F.col("__title").alias("title"), F.col("link").alias("url"), T.squeeze(F.col("__body")).alias("body"), F.to_timestamp("date").alias("published_at"), "found", F.lit(category).alias("force_category"))


NOTICE_SCHEMA = "data struct<catalogs: array<struct<catalogName: string, articles: array<struct<id: long, code: string, title: string, releaseDate: long>>>>>"


def catalog_notices(payloads: DataFrame, base_url: str) -> DataFrame:
    """Notices from nested JSON catalogs (source, payload)."""
    parsed = payloads.select("source", F.explode(F.from_json("payload", NOTICE_SCHEMA)["data"]["catalogs"]).alias("c"))
    each = parsed.select("source", F.col("c.catalogName").alias("catalog"), F.explode("c.articles").alias("a"))
    return each.select("source", F.col("a.code").alias("unique_id"), "a.title", F.concat(F.lit(base_url), "a.code").alias("url"), F.col("catalog").alias("body"), times.epoch(F.col("a.releaseDate")).alias("published_at"))


def flat_notices(payloads: DataFrame, zone: str = "Asia/Seoul") -> DataFrame:
    """Notices from a JSON array with categories, their dates in a zone."""
    each = payloads.select("source", F.explode(F.from_json("payload", "array<struct<categories: array<string>, title: string, pc_url: string, published_at: string>>")).alias("n"))
    return each.select("source", F.col("n.pc_url").alias("unique_id"), "n.title", F.col("n.pc_url").alias("url"), F.array_join("n.categories", " · ").alias("body"), times.local_time(F.col("n.published_at"), zone, ["yyyy-MM-dd HH:mm:ss"]).alias("published_at"))


def embedded_items(pages: DataFrame, depth: int = 6, most: int = 20) -> DataFrame:
    """url, slug, title of objects with both in a page's embedded data, level by level to a depth; each slug once a page."""
    script = F.regexp_extract("html", r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    level = pages.select("url", F.try_parse_json(F.nullif(script, F.lit(""))).alias("v")).where("v IS NOT NULL")
    found = []
    for _ in range(depth):
        found.append(level.select("url", F.try_variant_get("v", "$.slug", "string").alias("slug"), F.try_variant_get("v", "$.title", "string").alias("title")))
        level = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "k", "child")).select("url", F.col("child").alias("v"))
    every = reduce(DataFrame.unionByName, found).where("slug IS NOT NULL AND title IS NOT NULL").dropDuplicates(["url", "slug"])
    return every.withColumn("__rn", F.row_number().over(Window.partitionBy("url").orderBy("slug"))).where(F.col("__rn") <= most).drop("__rn")


def resolver_targets(rows: DataFrame, redirector: str) -> DataFrame:
    """(url, target) from a resolver's replies (url, reply): arrays whose text cells are JSON again; the first address that isn't the redirector's."""
    line = rows.select("url", F.explode(F.split("reply", "\n")).alias("line")).where(F.col("line").startswith("["))
    cell = line.select("url", F.explode(F.from_json("line", "array<array<string>>")).alias("cells")).select("url", F.posexplode("cells").alias("pos", "cell"))
    inner = cell.select("url", "pos", F.explode(F.from_json("cell", "array<string>")).alias("t"))
    return inner.where(F.col("t").startswith("http") & ~F.contains("t", F.lit(redirector))).groupBy("url").agg(F.min_by("t", "pos").alias("target"))


def listed_urls(lines: DataFrame) -> DataFrame:
    """URLs of a curated list (value): comments and blank lines skipped."""
    return lines.select(F.trim("value").alias("url")).where("url <> '' AND NOT startswith(url, '#')")


def truth_titles(rows: DataFrame) -> DataFrame:
    """Known titles (ok, title) without their tails; failed rows skipped."""
    return rows.where("ok").select(T.strip_tails(F.col("title")).alias("title")).where("title <> ''")


def all_sources(frames: list[DataFrame]) -> DataFrame:
    """The union of collectors; the order of the list is their precedence."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("precedence", F.lit(k)) for k, f in enumerate(frames)])


def urgent_lane(releases: DataFrame, stream: DataFrame, speeches: DataFrame, feeds: DataFrame, rules: R.RuleSet, routing: R.UrgentRouting, released: str = "release") -> DataFrame:
    """The urgent items of four sources (ITEM_COLUMNS, hint) with label, hint, tab, mirror and deep.

    releases are numbers of the calendar, stream rows carry their label in the hint ("prefix:label/place"), speeches belong to the home market, are mirrored
    and summarised in depth; of other feeds a title that a rule of urgency fits comes in, with its label added to the hint.
    """
    prefix = routing.prefix
    named = F.regexp_extract(F.coalesce("hint", F.lit("")), rf"^(?:{prefix}:)?([^/]*)", 1)
    label = {
        "releases": F.lit(released),
        "stream": F.coalesce(F.nullif(named, F.lit("")), F.lit(released)),
        "speeches": F.lit("speech"),
        "feeds": R.urgency(F.col("title"), rules),
    }
    lanes = []
    for name, rows in (("releases", releases), ("stream", stream), ("speeches", speeches), ("feeds", feeds)):
        rows = rows.withColumn("label", label[name]).where("label IS NOT NULL")
        if name == "feeds":
            rows = rows.withColumn("hint", F.ltrim(F.concat(F.coalesce("hint", F.lit("")), F.lit(f"/{prefix}:"), "label"), F.lit("/")))
        tab, mirror = R.target_tab(F.col("title"), F.col("hint"), routing), R.mirror_tab(F.col("label"), F.col("title"), F.col("hint"), routing)
        deep = F.col("label").isin(*routing.deep) if routing.deep and name == "feeds" else F.lit(name == "speeches")
        if name == "speeches":
            tab, mirror = F.lit(routing.home_tab), F.lit(routing.mirror_tab)
        lanes.append(rows.withColumns({"tab": tab, "mirror": mirror, "deep": deep}))
    return all_sources(lanes)
