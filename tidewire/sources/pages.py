"""Article pages: body paragraphs, title, description and time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as T

CONTAINERS = [r"<article\b[^>]*>(.*?)</article>", r"<main\b[^>]*>(.*?)</main>", r"<body\b[^>]*>(.*?)</body>"]
#: Where a page's title stands, the best place first.
TITLES = [r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)""", r"(?is)<title[^>]*>(.*?)</title>"]


def page_title(html: Column, places: list[str] = TITLES, decode: Callable[[Column], Column] = T.unescape) -> Column:
    """The first of the places that isn't empty, decoded, with single spaces; empty if there is none."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in places), F.lit(""))
    return T.squeeze(decode(found))


def description(html: Column) -> Column:
    return T.squeeze(T.unescape(F.regexp_extract(html, r"""(?is)<meta[^>]*(?:property|name)=["'](?:og:)?description["'][^>]*content=["']([^"']*)""", 1)))


def published_time(html: Column, now: Column, zone: str = "Asia/Seoul") -> Column:
    """The first of the usual places of a time, not in the future; one without a zone is the zone's."""
    places = [r"""article:published_time["'][^>]*content=["']([^"']+)""", r'"datePublished"\s*:\s*"([^"]+)"', r"""<time[^>]*datetime=["']([^"']+)""", r"""itemprop=["']datePublished["'][^>]*content=["']([^"']+)""", r"""name=["']date["'][^>]*content=["']([^"']+)""", r"(20\d\d[.-]\d\d[.-]\d\d \d\d:\d\d)"]
    found = F.coalesce(*(F.nullif(F.regexp_extract(html, f"(?is){p}", 1), F.lit("")) for p in places))
    zoned = F.when(found.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(found))
    plain = F.regexp_replace(F.regexp_replace(found, r"\.", "-"), "T", " ")
    local = F.to_utc_timestamp(F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm"))), zone)
    ts = F.coalesce(zoned, local)
    return F.when(ts <= now, ts)


def paragraphs(pages: DataFrame, least: int = 30, most: int = 40, budget: int = 12_000, boilerplate: str = "", tail: str = "", containers: list[str] = CONTAINERS, title: Callable[[Column], Column] = page_title) -> DataFrame:
    """url, container, n_paras, body: the page's (url, html) paragraphs from the container that holds most text.

    Scripts, menus, headers, footers and forms go first, and what follows `tail`. Lines under `least` characters, echoes of the title, boilerplate
    and repeated lines go; the line that crosses the budget is kept, and none after it. title: the title of html whose echo goes.
    """
    bare = F.regexp_replace("html", r"(?is)<(script|style|nav|header|footer|aside|form|figure)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, f"(?is)({tail}).*$", "") if tail else bare
    of = pages.select("url", title(F.col("html")).alias("title"), F.posexplode(F.array(*(F.regexp_extract(bare, f"(?is){c}", 1) for c in containers))).alias("container", "inner"))
    lines = F.split(F.regexp_replace("inner", r"(?i)</?(p|div|br|li|h[1-6]|tr|section)\b[^>]*>", "\n"), "\n")
    each = of.select("url", "title", "container", F.posexplode(F.transform(lines, lambda x: T.squeeze(F.regexp_replace(x, r"<[^>]*>", "")))).alias("pos", "line"))
    kept = each.where((F.length("line") >= least) & (F.col("line") != F.col("title")))
    if boilerplate:
        kept = kept.where(~F.col("line").rlike(f"(?i){boilerplate}"))
    by = Window.partitionBy("url", "container")
    kept = kept.withColumn("__rn", F.row_number().over(Window.partitionBy("url", "container", "line").orderBy("pos"))).where("__rn = 1")
    before = F.coalesce(F.sum(F.length("line")).over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumns({"__before": before, "__n": F.row_number().over(by.orderBy("pos"))}).where((F.col("__before") < budget) & (F.col("__n") <= most))
    bodies = kept.groupBy("url", "container").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"), F.sum(F.length("line")).alias("total"))
    best = bodies.groupBy("url").agg(F.max_by(F.struct("container", "ls", "total"), F.struct("total", -F.col("container"))).alias("b"))
    return best.select("url", "b.container", F.size("b.ls").alias("n_paras"), F.col("b.total").cast("long").alias("n_chars"), F.array_join(F.transform("b.ls", lambda x: x["line"]), "\n").alias("body"))


def readable(n_chars: Column, url: Column, paywalled: list[str], least: int = 400) -> Column:
    """Why a body can't be used, or null: a paywalled site, or too little text."""
    wall = F.exists(F.array(*map(F.lit, paywalled)), lambda d: F.contains(url, d)) if paywalled else F.lit(False)
    return F.when(wall, "paywall").when(F.coalesce(n_chars, F.lit(0)) < least, "short")
