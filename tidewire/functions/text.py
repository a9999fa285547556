"""Text and title functions as Columns."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no function for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references decoded; Spark has no function for it."""
    return text.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def ampersands(text: Column) -> Column:
    """Only &amp; decoded; other references stay as they stand in the source."""
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_title(title: Column, compatible: bool = False) -> Column:
    """Lower case, without [..] and (..), with words and single spaces only. compatible: NFKC first (an Arrow function)."""
    title = F.coalesce(title, F.lit(""))
    title = nfkc(title) if compatible else title
    bare = F.regexp_replace(title, r"\[[^\]]*\]|\([^)]*\)", " ")
    return F.lower(squeeze(F.regexp_replace(bare, r"[^\p{L}\p{N}_ ]+", " ")))


def tokens(title: Column, stop: list[str] = (), compatible: bool = False) -> Column:
    """The distinct words of a title of two characters or more, without stop words."""
    words = F.array_distinct(F.filter(F.split(normal_title(title, compatible), " "), lambda w: F.length(w) > 1))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Shared over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1)))


def keywords(title: Column, n: int = 6) -> Column:
    """The first n words of two characters or more, as a search term."""
    words = F.filter(F.split(squeeze(F.regexp_replace(title, r"[^\p{L}\p{N} ]+", " ")), " "), lambda w: F.length(w) > 1)
    return F.array_join(F.slice(words, 1, n), " ")


#: Amounts and counts say nothing of an event.
NUMBER = r"^[0-9][0-9,.]*\p{L}{0,2}%?$"


def distinctive(words: Column, generic: list[str], names: Column | None = None) -> Column:
    """Words that tell one event from another: not generic, no numbers, and, given names, neither part of a name nor holding one."""
    kept = F.filter(F.array_except(words, F.array(*map(F.lit, generic)) if generic else F.array().cast("array<string>")), lambda w: ~w.rlike(NUMBER) & (F.length(w) >= 2))
    if names is None:
        return kept
    return F.filter(kept, lambda w: ~F.exists(names, lambda n: (n != "") & (F.contains(n, w) | F.contains(w, n))))


def stem_hits(a: Column, b: Column, least: int = 2, prefix: int = 3) -> Column:
    """How many words of a (not of b) start, or are started by, a word of b, or share its first letters. Not symmetric."""
    like = lambda x, y: x.startswith(y) | y.startswith(x) | ((F.length(x) >= prefix) & (F.length(y) >= prefix) & (F.substring(x, 1, prefix) == F.substring(y, 1, prefix)))
    return F.size(F.filter(a, lambda x: (F.length(x) >= least) & F.exists(b, lambda y: (F.length(y) >= least) & like(x, y))))


def plain(markup: Column) -> Column:
    """Markup to text: line breaks kept, tags dropped, references decoded."""
    return unescape(F.regexp_replace(F.regexp_replace(markup, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", ""))


def visible_length(markup: Column) -> Column:
    return F.length(plain(markup))


def cut(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis if some went."""
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


def scrub(text: Column, words: list[str]) -> Column:
    """Takes words out, and the double blanks that leaves."""
    for w in words:
        text = F.replace(text, F.lit(w), F.lit(""))
    return squeeze(text)


def foreign_parts(text: Column, script: str = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]") -> Column:
    """Distinct words in a foreign script, without markup, brackets and outer punctuation."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\([^)]*\)", " ")
    words = F.transform(F.split(bare, r"[\s,·/]+"), lambda w: F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: w.rlike(script)))


def glossary(text: Column, entries: dict[str, str]) -> Column:
    """Replaces each key, the longest first."""
    for k in sorted(entries, key=lambda k: (-len(k), k)):
        text = F.replace(text, F.lit(k), F.lit(entries[k]))
    return text


def matched(text: Column, words: list[str]) -> Column:
    """The words of a list that a text contains, in the list's order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), F.lower(w)))


def acronym(word: str) -> str:
    """A pattern for a word that has no ASCII letter or digit next to it."""
    return rf"(?<![A-Za-z0-9]){word}(?![A-Za-z0-9])"


def hashtags(topic: Column, tags: Column, banned: list[str], most: int = 5) -> Column:
    """The topic's tag and then the others, letters and digits only, without banned ones, distinct."""
    bare = F.transform(F.concat(F.array(topic), F.coalesce(tags, F.array().cast("array<string>"))), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_]", ""))
    fit = F.filter(bare, lambda t: (t != "") & ~t.isin(banned) if banned else t != "")
    return F.slice(F.array_distinct(fit), 1, most)


def split_outlet(title: Column, longest: int = 40) -> tuple[Column, Column]:
    """(title, outlet) of "title - outlet", by the last dash; the outlet is shorter than `longest`, else null."""
    pattern = rf"^(.*) - ([^-].{{0,{longest - 2}}})$"
    outlet = F.nullif(F.regexp_extract(title, pattern, 2), F.lit(""))
    return F.when(outlet.isNotNull(), F.trim(F.regexp_extract(title, pattern, 1))).otherwise(title), F.trim(outlet)


def strip_tails(title: Column) -> Column:
    """Drops what follows the last " - ", " | " or " :: "."""
    for sep in (" - ", r" \| ", " :: "):
        title = F.regexp_replace(title, rf"^(.+){sep}(?!.*{sep}).*$", "$1")
    return F.trim(title)


def first_sentence(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.split(F.coalesce(text, F.lit("")), r"\. ")[0]), r"\.+$", "")
