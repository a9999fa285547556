"""Reading back what was published: the sections of a text, and labels of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import text as T


#: Fixed values of the published format, which must match for right results: what opens a part, what closes it, and what a part may have at its ends.
#: A part of an own line ends with it; others end at an empty line, or at the mark given.
PUBLISHED = {
    "lede": (["✅ <b>[^<]*</b>\n"], r"\n\n|$", ""),
    "bullets": (["<blockquote>"], "</blockquote>", " •"),
    "why": (["🐧", "💡 <b>[^<]*</b>\n"], r"\n\n|$", ""),
    "at": (["(?m)^🕒"], "\n|$", ""),
    "source": ([r"</a>\s*-"], "\n|$", ""),
}
#: The same of the older format.
OLDER = {
    "headline": ([r"(?m)^\S+[^\S\n]*<b>"], "</b>", ""),
    "lede": (["(?m)^☑️"], "\n|$", ""),
    "comment": (["(?m)^🐧"], "\n|$", ""),
    "bullets": ([r"(?m)^📁\s*<b>[^\n]*?</b>\s*\n<blockquote>"], "</blockquote>", "• "),
    "tags": (["(?m)^(?=#\\S)"], "\n|$", ""),
}


def read_part(text: Column, form: dict[str, tuple[list[str], str, str]], name: str) -> Column:
    """One part of a text by a table of marks: what lies between the first of its openings that is there and its closing, trimmed; else null."""
    openings, closing, _ = form[name]
    found = []
    for opening in openings:
        rest = F.element_at(F.split(F.coalesce(text, F.lit("")), opening, 2), -1)
        opened = F.coalesce(text, F.lit("")).rlike(opening)
        end = F.regexp_instr(rest, F.lit(closing.removesuffix("|$")))
        closed = F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest if closing.endswith("|$") else F.lit(None))
        found.append(F.when(opened, F.nullif(F.trim(closed), F.lit(""))))
    return F.coalesce(*found)


def read_list(text: Column, form: dict[str, tuple[list[str], str, str]], name: str, between: str) -> Column:
    """The entries of a part, without the characters that may stand at their ends and without empty ones."""
    ends = form[name][2]
    each = F.split(F.coalesce(read_part(text, form, name), F.lit("")), between)
    return F.filter(F.transform(each, lambda x: F.btrim(F.btrim(x), F.lit(ends + " "))), lambda x: x != "")


def sections(text: Column) -> Column:
    """lede, bullets, why, at, source of a published text; what is missing is null or empty. A source with a name in brackets at its end goes by that."""
    part = lambda name: read_part(text, PUBLISHED, name)
    source = part("source")
    bracketed = F.nullif(F.regexp_extract(source, r"^.+?\((.+)\)$", 1), F.lit(""))
    return F.struct(part("lede").alias("lede"), read_list(text, PUBLISHED, "bullets", "\n").alias("bullets"), part("why").alias("why"), part("at").alias("at"), F.trim(F.coalesce(bracketed, source)).alias("source"))


def missing_parts(headline: Column, lede: Column, comment: Column, bullets: Column) -> Column:
    """Names of the required parts that a text lacks."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    named = [F.when(blank(c), n) for n, c in (("headline", headline), ("lede", lede), ("comment", comment))]
    return F.array_compact(F.array(*named, F.when(F.coalesce(F.size(bullets), F.lit(0)) <= 0, "bullets")))


def older_parts(text: Column) -> Column:
    """headline, lede, comment, bullets, tags of the older form of a published text."""
    tags = F.filter(F.transform(read_list(text, OLDER, "tags", r"\s+"), lambda t: F.ltrim(t, F.lit("#"))), lambda t: t != "")
    parts = [read_part(text, OLDER, name).alias(name) for name in ("headline", "lede", "comment")]
    return F.struct(*parts, read_list(text, OLDER, "bullets", "\n").alias("bullets"), tags.alias("tags"))


#: Fixed values that must match for right results: endings of domain names that don't make a name another one.
DOMAIN_ENDINGS = ["com", "net", "org", "kr", "jp", "co.kr", "news", "pro", "io", "info"]


def same_name(a: Column, b: Column, endings: list[str] = DOMAIN_ENDINGS) -> Column:
    """Whether two names are one but for case, blanks and the domain ending of b."""
    plain = lambda c: F.lower(F.regexp_replace(c, " ", ""))
    return F.array_contains(F.array(plain(a), *(F.concat(plain(a), F.lit(f".{e}")) for e in endings)), plain(b))


def source_label(raw: Column, wrapper: str, droppable: list[str], tails: list[str], endings: list[str] = DOMAIN_ENDINGS) -> Column:
    """A source's name for readers.

    A name has the form `core (note) tail`, where wrapper's first group is a whole name again. The note stays unless it says nothing: it
    is droppable, or the core under another spelling. A tail word goes.
    """
    name = F.trim(F.coalesce(raw, F.lit("")))
    whole = F.when(name.rlike(wrapper), F.trim(F.regexp_extract(name, wrapper, 1))).otherwise(name)
    core, note = (F.trim(F.regexp_extract(whole, r"^(.*?)\s*\((.+)\)\s*$", k)) for k in (1, 2))
    silent = (note != "") & (note.isin(droppable) | same_name(core, note, endings))
    label = F.when(silent, core).otherwise(whole)
    for_tail = F.array(*map(F.lit, tails)) if tails else F.array().cast("array<string>")
    last = F.regexp_extract(label, r"\s(\S+)$", 1)
    return F.when(F.array_contains(for_tail, last), F.trim(F.regexp_replace(label, r"\s\S+$", ""))).otherwise(label)


def moment_label(ts: Column, zone: str, pattern: str = "MM.dd HH:mm") -> Column:
    """A time for display in a zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)


def queries_without_age(queries: Column) -> Column:
    """Search terms without their age limits, each once, in order."""
    return F.array_distinct(F.transform(queries, lambda q: T.squeeze(F.regexp_replace(q, r"\bwhen:\d+[dhm]\b", ""))))
