"""Texts for readers, put together from an item's parts: an article, an entry of an edition, a link list, a digest. All are Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import published
from tidewire.functions import text as T

#: Characters that a text of markup must write as references.
REFERENCES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}


@dataclass(frozen=True)
class Form:
    """The marks and labels of a deployment's texts."""

    name: str = "tidewire"
    lede: str = "✅"
    points: str = "📂"
    why: str = "🐧"
    update: str = "🔁"
    clock: str = "🕒"
    via: str = "📎"
    signals: str = "🚨"
    no_icon: str = "📰"
    lede_label: str = "Core"
    points_label: str = "Details"
    update_label: str = "New facts"
    signals_label: str = "Key signals"
    link_label: str = "Original article"
    via_label: str = "Source"
    origin_label: str = "original"
    promotion_label: str = "promotion"
    nothing: str = "Nothing to report in this window."


def escaped(text: Column) -> Column:
    """A text with its markup characters as references; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for raw, reference in REFERENCES.items():
        text = F.replace(text, F.lit(raw), F.lit(reference))
    return text


def _lines(*parts: tuple[Column | None, list]) -> Column:
    """Lines of the parts whose condition holds (None: always), joined by line feeds."""
    every = [F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines)) for _, lines in parts]
    kept = [a if c is None else F.when(c, a).otherwise(F.array().cast("array<string>")) for (c, _), a in zip(parts, every)]
    return F.array_join(F.flatten(F.array(*kept)), "\n")


def _given(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) != ""


def _bare(text: Column, *marks: str) -> Column:
    """A trimmed text without a mark that it already starts with."""
    out = F.trim(F.coalesce(text, F.lit("")))
    for m in marks:
        out = F.when(out.startswith(m), F.trim(F.substring(out, len(m) + 1, 1 << 30))).otherwise(out)
    return out


def one_line(text: Column, width: int = 110) -> Column:
    """A text in one line of at most `width` characters, cut at the last blank before."""
    flat = T.squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) > width, F.concat(F.regexp_replace(F.substring(flat, 1, width), r" [^ ]*$", ""), F.lit("…"))).otherwise(flat)


def shown_length(text: Column) -> Column:
    """Characters that readers see of a text made here: no tags, and a reference is one."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), "&(?:" + "|".join(r[1:-1] for r in REFERENCES.values()) + ");", "."))


def icon(name: Column, form: Form) -> Column:
    """The sign in front of a topic's display name ("sign name"); the form's own for a topic without one."""
    return F.when(_given(name), F.split(name, " ")[0]).otherwise(F.lit(form.no_icon))


def topic_name(name: Column, topic: Column) -> Column:
    """A topic's display name without its sign; an unknown topic's id."""
    shown = F.coalesce(F.nullif(name, F.lit("")), topic, F.lit(""))
    return F.when(F.contains(shown, F.lit(" ")), F.regexp_extract(shown, r"(?s)^[^ ]* (.*)$", 1)).otherwise(shown)


def is_repost(source: Column, prefix: str = "TG:") -> Column:
    """Taken over from another channel, which is not where it comes from."""
    return F.coalesce(source.startswith(prefix), F.lit(False))


def origin(url: Column, author: Column, platform: Column, form: Form, handles: dict[str, str] | None = None) -> Column:
    """(label, url) of where a repost comes from: its author, else its platform, else the form's word.

    Without an address a handle (@name) leads to its page, if handles has an address for the platform (with {} for the name).
    """
    url, author, platform = (F.trim(F.coalesce(c, F.lit(""))) for c in (url, author, platform))
    page = F.lit("")
    for name, address in (handles or {"X": "https://x.com/{}"}).items():
        before, after = address.split("{}")
        page = F.when((platform == name) & author.startswith("@"), F.concat(F.lit(before), F.substring(author, 2, 1 << 30), F.lit(after))).otherwise(page)
    label = F.coalesce(F.nullif(author, F.lit("")), F.nullif(platform, F.lit("")), F.lit(form.origin_label))
    return F.struct(label.alias("label"), F.when(url != "", url).otherwise(page).alias("url"))


def posted_label(at: Column, zone: str = "Asia/Seoul", name: str = "KST") -> Column:
    """When an item appeared, in a zone; empty if unknown."""
    return F.coalesce(F.concat(published.moment_label(at, zone, "yyyy-MM-dd HH:mm"), F.lit(f" {name}")), F.lit(""))


def source_line(url: Column, outlet: Column, repost: Column, origin_: Column, form: Form) -> Column:
    """The line that names the source: a link to the article with its outlet; of a repost, where it comes from, linked if that is known."""
    link = F.concat(F.lit('<a href="'), escaped(url), F.lit(f'">{form.link_label}</a>'))
    own = F.when(_given(outlet), F.concat(link, F.lit(" - "), escaped(outlet))).otherwise(link)
    label = escaped(origin_["label"])
    linked = F.concat(F.lit('<a href="'), escaped(origin_["url"]), F.lit('">'), label, F.lit("</a>"))
    return F.when(repost, F.concat(F.lit(f"{form.via} {form.via_label}: "), F.when(origin_["url"] != "", linked).otherwise(label))).otherwise(own)


def article(headline: Column, lede: Column, points: Column, why: Column, update: Column, posted: Column, source: Column, tags: Column, topic_icon: Column, form: Form, in_caption: Column | None = None) -> Column:
    """The text of one item. in_caption: a picture's caption holds the headline, so headline and time are left out."""
    shown = F.lit(True) if in_caption is None else ~in_caption
    summary, comment, news = _bare(lede, form.lede), _bare(why, "💡", form.why), _bare(update, form.update)
    bullets = F.array_join(F.transform(points, lambda b: F.concat(F.lit("• "), escaped(b))), "\n")
    return _lines(
        (None, [f"<b>{form.name}</b>", ""]),
        (shown, [F.concat(topic_icon, F.lit(" <b>"), escaped(headline), F.lit("</b>")), ""]),
        (summary != "", [f"{form.lede} <b>{form.lede_label}</b>", escaped(summary), ""]),
        (F.coalesce(F.size(points) > 0, F.lit(False)), [f"{form.points} <b>{form.points_label}</b>", F.concat(F.lit("<blockquote>"), bullets, F.lit("</blockquote>")), ""]),
        (comment != "", [F.concat(F.lit(f"{form.why} "), escaped(comment)), ""]),
        (news != "", [f"{form.update} <b>{form.update_label}</b>", escaped(news), ""]),
        (_given(posted) & shown, [F.concat(F.lit(f"{form.clock} "), escaped(posted)), ""]),
        (None, [source, "", escaped(tags)]),
    )


def edition_entry(place: Column, headline: Column, url: Column, lede: Column, why: Column, topic_icon: Column, topic: Column, form: Form, width: int = 110) -> Column:
    """One entry of an edition: number, topic, linked headline, a line each of what it says and why it matters."""
    head = escaped(headline)
    linked = F.when(_given(url), F.concat(F.lit('<a href="'), escaped(F.trim(url)), F.lit('">'), head, F.lit("</a>"))).otherwise(head)
    core, reason = one_line(lede, width), one_line(why, width)
    return _lines(
        (None, [F.concat(F.lit("<b>"), place.cast("string"), F.lit(". "), topic_icon, F.lit(" ["), escaped(topic), F.lit("]</b>")), linked]),
        (_given(core), ["", F.concat(F.lit(f"<b>{form.lede_label}</b>  "), escaped(core))]),
        (_given(reason), [F.concat(F.lit(f"{form.why} "), escaped(reason))]),
        (None, [""]),
    )


def stored_entry(text: Column, topic: Column, promotion: Column, url: Column, resolved: Column, form: Form) -> Column:
    """An item's published text under its topic: without the line of the name, addresses resolved, the headline a link."""
    body = F.trim(F.coalesce(text, F.lit("")))
    body = F.regexp_replace(body, rf"^[^\n]*{form.name}[^\n]*(\n|$)(\s*\n)*", "")
    known = _given(resolved) & _given(url) & (url != resolved)
    body = F.when(known, F.replace(F.replace(body, escaped(url), escaped(resolved)), url, resolved)).otherwise(body)
    target = escaped(F.coalesce(F.nullif(resolved, F.lit("")), url))
    # The first line of a sign and a bold headline, unless a link comes before it.
    lines, bold = F.split(body, "\n"), r"^(\S+)\s+<b>(.+)</b>\s*$"
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("<a ")) | x.rlike(bold)), True)
    replaced = F.transform(lines, lambda x, i: F.when((i + 1 == at) & ~F.contains(x, F.lit("<a ")), F.regexp_replace(x, bold, '$1 <a href="\u0000"><b>$2</b></a>')).otherwise(x))
    body = F.when(_given(target), F.replace(F.array_join(replaced, "\n"), F.lit("\u0000"), target)).otherwise(body)
    mark = F.when(promotion, F.lit(f" · {form.promotion_label}")).otherwise("")
    return F.concat(F.lit("<b>["), escaped(topic), F.lit("]</b>"), mark, F.lit("\n\n"), body)


def link_entry(place: Column, headline: Column, view: Column, url: Column, points: Column) -> Column:
    """One entry of a link list: number, linked headline, the bullets as they were published, the address."""
    head = F.concat(F.lit("<b>"), place.cast("string"), F.lit('.</b> <a href="'), escaped(F.coalesce(F.nullif(view, F.lit("")), url)), F.lit('"><b>'), escaped(F.trim(headline)), F.lit("</b></a>"))
    return _lines((None, [head]), (_given(points), [points]), (None, [F.concat(F.lit('<a href="'), escaped(url), F.lit('">'), escaped(url), F.lit("</a>"))]))


def digest(name: Column, label: Column, summary: Column, points: Column, takeaway: Column, n: Column, form: Form, title: str = "digest", count: str = "items") -> Column:
    """The digest of one category: title, summary, bullets, a line to take away, the count."""
    bullets = F.array_join(F.transform(points, lambda b: F.concat(F.lit("• "), escaped(b))), "\n")
    return _lines(
        (None, [F.concat(F.lit("🗂 <b>"), escaped(name), F.lit(" · "), escaped(label), F.lit(f" {title}</b>")), "", escaped(summary)]),
        (F.coalesce(F.size(points) > 0, F.lit(False)), ["", F.concat(F.lit("<blockquote>"), bullets, F.lit("</blockquote>"))]),
        (_given(takeaway), ["", F.concat(F.lit(f"{form.why} "), escaped(takeaway))]),
        (None, ["", F.concat(F.lit("<i>"), n.cast("string"), F.lit(f" {count}</i>"))]),
    )


def edition(entries: DataFrame, by: list[str], label: str, form: Form, title: str, signals: DataFrame | None = None) -> DataFrame:
    """by, text: the entries (place, entry) of each edition as one text under a title, with the signals (by, signals) below. An edition's entries are few."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda s: s["entry"]), "\n")
    whole = entries.groupBy(*by, label).agg(text.alias("body"))
    whole = whole.join(signals, by, "left") if signals is not None else whole.withColumn("signals", F.array().cast("array<string>"))
    signs = F.array_join(F.transform("signals", lambda s: F.concat(F.lit("• "), escaped(s))), "\n")
    return whole.select(*by, _lines(
        (None, [f"☀️ <b>{form.name} | {title}</b>", "", escaped(F.col(label).cast("string")), "", F.col("body")]),
        (F.coalesce(F.size("signals") > 0, F.lit(False)), ["━━━━━━━━━━━━━━", "", f"{form.signals} <b>{form.signals_label}</b>", "", signs]),
    ).alias("text"))


def messages(entries: DataFrame, by: list[str], limit: int, head: Column | None = None) -> DataFrame:
    """by, part, text: an edition's entries (place, entry) as messages of at most `limit` visible characters, none of them cut.

    An entry opens a new message where it doesn't fit any more; one that is too long alone is a message by itself. head stands in front of the first.
    The entries of an edition are few; they are folded in order in one aggregate.
    """
    pieces = entries.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda s: s["entry"]).alias("pieces"), *([] if head is None else [F.first(head).alias("head")]))
    begin = F.array().cast("array<string>") if head is None else F.array("head")

    def put(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last, F.lit("\n\n"), x)
        only_head = F.lit(head is not None) & (F.size(acc) == 1) & (last == acc[0]) & (F.col("head") == last if head is not None else F.lit(False))
        fits = (shown_length(joined) <= limit) | only_head
        return F.when(F.size(acc) == 0, F.array(x)).when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return pieces.select(*by, F.posexplode(F.aggregate("pieces", begin, put)).alias("part", "text"))
