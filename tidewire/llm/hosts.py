"""URL filter by empirical-Bayes host reputation, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import stage

#: Rules of the registered query: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]



@dataclass(frozen=True)
class Suffixes:
    """Under which suffixes names are registered.

    second: second-level labels that make a suffix with a country's two letters, as in `co.uk`; else the last label is the suffix.
    rules: suffixes of an owner's list, which go before that: `a.b`, `*.b` (any label before b) and `!c.b` (c.b is a name after all);
    exceptions win, then the longest.
    """

    second: tuple[str, ...] = ("ac", "co", "com", "edu", "go", "gov", "mil", "ne", "net", "nom", "or", "org")
    rules: tuple[str, ...] = ()


#: Bounds of the estimated strength of a prior, in pages.
STRENGTH = (2.0, 1000.0)


def host_of(url: Column) -> Column:
    """Host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: host or a subdomain of it, and a path that starts with the rule's. Nulls if none."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def suffix_length(host: Column, suffixes: Suffixes = Suffixes()) -> Column:
    """How many labels of a host are its suffix."""
    by_country = rf"(^|\.)({'|'.join(suffixes.second)})\.[a-z][a-z]$" if suffixes.second else "(?!)"
    usual = F.when(host.rlike(by_country), 2).otherwise(1)
    listed, but = [], []
    for rule in suffixes.rules:
        name = rule.lstrip("!*").lstrip(".")
        below, labels = host.endswith(f".{name}"), name.count(".") + 1
        if rule.startswith("!"):
            but.append(F.when(below | (host == name), labels - 1))
        else:
            listed.append(F.when(below, labels + 1) if rule.startswith("*") else F.when(below | (host == name), labels))
    longest = F.array_max(F.array(*listed)) if listed else F.lit(None).cast("int")
    return F.coalesce(*but, longest, usual)


def _last_labels(host: Column, n: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -n)


def suffix_of(host: Column, suffixes: Suffixes = Suffixes()) -> Column:
    return _last_labels(host, suffix_length(host, suffixes))


def domain_of(host: Column, suffixes: Suffixes = Suffixes()) -> Column:
    """The registered domain: the suffix and one label more, or the host where there is none."""
    return _last_labels(host, suffix_length(host, suffixes) + 1)


def _shrunk(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Posterior mean m and variance v of the bad rate of each child under a beta prior around its parent's mean.

    The prior's strength is the same for all children of a level, from the spread of their counts about the parents' means:
    with Var(bad) = n m (1 - m) (1 + (n - 1) rho), rho by the method of moments over all children, and
    strength = 1 / rho - 1 within STRENGTH. What isn't known of the parent's mean adds to the variance, as far as it was drawn on.
    """
    rows = children.join(parents, parent)
    m, n, bad = F.col("mean"), F.col("n"), F.col("bad")
    over = F.sum((bad - n * m) * (bad - n * m) - n * m * (1 - m))
    under = F.sum(n * (n - 1) * m * (1 - m))
    rho = F.when(under > 0, over / under).otherwise(0.0)
    low, high = 1 / (1 + STRENGTH[1]), 1 / (1 + STRENGTH[0])
    s = F.lit(rows.agg(1 / F.least(F.greatest(F.coalesce(rho, F.lit(low)), F.lit(low)), F.lit(high)) - 1).first()[0])  # one number
    mean = (bad + s * m) / (n + s)
    spread = mean * (1 - mean) / (n + s + 1) + F.pow(s / (n + s), 2) * F.col("var")
    return rows.select(*children.columns, mean.alias("m"), spread.alias("v"))


def reputation(outcomes: DataFrame, z: float = 1.645, suffixes: Suffixes = Suffixes()) -> DataFrame:
    """host, n, bad, mean, low (posterior lower bound of the bad rate), base (the rate of all) from labelled pages (host string, bad int 0 or 1, and perhaps n: how many such pages).

    Counts are taken per host, registered domain and suffix, and shrunk downwards: suffixes towards the mean of all,
    domains towards their suffix, hosts towards their domain. The bound is the mean less z standard deviations of the
    host's beta posterior.
    """
    per = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    times = F.col("n") if "n" in outcomes.columns else F.lit(1)
    counts = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.sum(times).cast("double").alias("n"), F.sum(F.col("bad") * times).cast("double").alias("bad"))
    hosts = stage(counts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes), "top": F.lit(0)}))
    domains = per(hosts, "domain", "suffix", "top")
    suffixes_ = per(domains, "suffix", "top")
    top = per(suffixes_, "top").select("top", ((F.col("bad") + 0.5) / (F.col("n") + 1)).alias("mean"), F.lit(0.0).alias("var"))
    of_suffix = _shrunk(suffixes_, top, "top").select("suffix", F.col("m").alias("mean"), F.col("v").alias("var"))
    of_domain = _shrunk(domains, of_suffix, "suffix").select("domain", F.col("m").alias("mean"), F.col("v").alias("var"))
    of_host = _shrunk(hosts, of_domain, "domain")
    base = top.select("top", F.col("mean").alias("base"))
    return of_host.join(base, "top").select("host", "n", "bad", F.col("m").alias("mean"), (F.col("m") - z * F.sqrt("v")).alias("low"), "base")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], worse: float = 1.0, z: float = 1.645, suffixes: Suffixes = Suffixes()) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_low for every row of pages (page_id, url).

    The longest rule decides; else a page is blocked if the posterior lower bound of its host's bad rate is above `worse` times the
    rate of all labelled pages: if the host is credibly worse than pages are on the whole.
    Hosts without labelled pages are allowed. A null url, or one without `://`, has an empty host and path and is allowed;
    other columns are not used. Rows that repeat are judged one by one. An empty table gives an empty result; without outcomes the rules alone decide.
    """
    known = reputation(outcomes, z, suffixes).select("host", F.col("mean").alias("bad_mean"), F.col("low").alias("bad_low"), (F.col("low") > worse * F.col("base")).alias("__bad"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(known, "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("__bad"), "block"), F.lit("allow")).alias("verdict"), "bad_mean", "bad_low")


def outcomes_by_text(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """host, bad (1 - quality), n: how many pages of the host have the text of a labelled document, in the article or else in the main part or the body.

    Both texts are compared without markup and white space, by their SHA-256; empty ones are no evidence. A page that fits several labelled
    documents counts once, as bad if any of them is. Pages of a host with one text are added up before they meet the documents.
    """
    bare = lambda c: F.regexp_replace(c, r"[\s\x{A0}]+", "")
    marked = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    texts = docs.where("text IS NOT NULL").select("doc_id", bare(F.col("text")).alias("t")).where("t != ''").select("doc_id", F.sha2("t", 256).alias("h"))
    texts = texts.join(marked, "doc_id").groupBy("h").agg(F.max("bad").alias("bad"))
    part = lambda tag: F.nullif(F.regexp_extract("html", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    article = F.coalesce(part("article"), part("main"), part("body"), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(article, r"(?is)<h1\b[^>]*>.*?</h1>", ""), r"(?s)<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    read = pages.where("html IS NOT NULL").select(host_of(F.col("url")).alias("host"), bare(plain).alias("t")).where("t != ''")
    read = read.groupBy("host", F.sha2("t", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return read.join(texts, "h").groupBy("host", F.col("bad").cast("int").alias("bad")).agg(F.sum("n").alias("n"))
