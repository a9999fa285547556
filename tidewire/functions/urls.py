"""URL functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_TRACKING = r"^(utm_.*|fbclid|gclid)(=.*)?$"


def host(url: Column) -> Column:
    """Lower-case host without `www.`; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _HOST, 1)), r"^www\.", "")


def normalize_url(url: Column) -> Column:
    """host/path?query of a URL, equal for equal articles.

    Scheme, user, port, `www.`, fragment, trailing slashes and tracking parameters go; other parameters stay in their order,
    blank ones too (`a` becomes `a=`). A null or empty URL gives an empty string.
    """
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(trimmed, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING))
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    joined = F.array_join(kept, "&")
    whole = F.concat(host(trimmed), F.when(path == "", "/").otherwise(path), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    return F.when(trimmed == "", "").otherwise(F.coalesce(F.nullif(F.ltrim(whole, F.lit("/")), F.lit("")), F.lower(trimmed)))


def item_key(source: Column, unique: Column) -> Column:
    return F.sha2(F.concat(source, F.lit("::"), unique), 256)


#: Where the sites' addresses carry an article's number.
ARTICLE_NUMBERS = [
    r"idxno=(\d+)", r"newsId=(\w+)", r"ncode=(\w+)", r"ar_id=(\d+)", r"\bno=(\d+)", r"AKR(\d+)", r"key=(\w+)", r"/v/(\d+)", r"articles?/(\d+)",
    r"/page/view/(\d+)", r"/news/view/(\d+)", r"/article/(\d+)", r"/amp/(\d+)", r"/view\.php\?ud=(\w+)",
]


def article_key(url: Column, patterns: list[str] = ARTICLE_NUMBERS, aggregator: str = "google") -> Column:
    """host#number by the leftmost pattern that fits; empty if none does, or on an aggregator's host."""
    url = F.coalesce(url, F.lit(""))
    hit = F.regexp_extract(url, "|".join(f"(?:{p})" for p in patterns).join(("(", ")")), 0)
    number = F.coalesce(*(F.nullif(F.regexp_extract(hit, p, 1), F.lit("")) for p in patterns), F.lit(""))
    site = F.regexp_replace(F.regexp_extract(F.regexp_replace(url, r"^https?://", ""), r"^([^/]*)", 1), r"^(www\.|m\.|view\.|news\.|biz\.)", "")
    return F.when((number == "") | F.contains(site, F.lit(aggregator)), "").otherwise(F.concat(site, F.lit("#"), number))


def host_label(url: Column) -> Column:
    """Host for display."""
    return F.regexp_replace(host(url), r"^(m|mobile|amp)\.", "")
