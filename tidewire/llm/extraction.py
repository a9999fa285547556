"""Main text of web pages by a conditional random field over leaf blocks."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.common import python_batches
from tidewire.llm.labelled_pages import labelled

#: Hashed features; labelled pages that a fit takes.
BUCKETS, TRAIN_PAGES = 1 << 14, 800

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"""[>"']""")
#: Elements that are dropped with all they hold.
_DROPPED = re.compile(r"(?i)script|style|noscript|template|svg|iframe|object")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
#: Elements within a line; any other one ends a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening element closes, if it is the innermost.
_CLOSES = {"p": "p", "li": "li", "dt": "dd", "dd": "dt", "option": "option", "tr": "tr", "td": "td", "th": "td"}
_BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Fixed words that tell page furniture.
_WORDS = frozenset("accept advertisement advertorial comment comments cookie cookies copyright home login menu newsletter policy privacy read related reply reserved rights search share sign sponsored subscribe terms".split())


class Tags:
    """The tags of a page in order, as (start, end, name or "", closing, attributes); comments and dropped elements have no name.

    A quoted value may hold `>`. Where a quote isn't closed, this and all later tags end at the first `>`, and a tag without any end takes
    the rest of the page, so that the time taken is in proportion to the page, whatever is wrong with it.
    """

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def __iter__(self):
        page, at = self.page, self.page.find("<")
        while at >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
                yield at, end, "", False, ""
            elif m := _NAME.match(page, at + 1):
                closing, name = page[at + 1] == "/", m[0].lstrip("/").lower()
                stop = self._end(m.end())
                end = stop + 1
                if not closing and _DROPPED.fullmatch(name) and stop < len(page):
                    found = re.compile(rf"(?i)</{name}\s*>").search(page, end)
                    yield at, found.end() if found else len(page), "", False, ""
                    end = found.end() if found else len(page)
                else:
                    yield at, min(end, len(page)), name if stop < len(page) else "", closing, page[m.end() : stop]
            elif page[at + 1 : at + 2] in ("!", "?", "/", "["):
                end = page.find(">", at)
                end = len(page) if end < 0 else end + 1
                yield at, end, "", False, ""
            else:
                end = at + 1
            at = page.find("<", end)

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin here; the length of the page if it doesn't."""
        begin = at
        while self.quotes:
            m = _STOP.search(self.page, at)
            if not m:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                at = self.page.find(m[0], m.end()) + 1
                self.quotes = at > 0
        end = self.page.find(">", begin)
        return len(self.page) if end < 0 else end


#: Elements that only wrap: without a class or id they say nothing of what they hold.
_WRAPPERS = frozenset("div section span tbody thead tr table html center font".split())


#: Said of a block that stands behind the end of an article or main part, and in none.
_BEHIND = frozenset({"behind"})


class Block(NamedTuple):
    """A leaf block: its text, its own tag, the two nearest elements around it that say something, all that any ancestor says, and its share of link text."""

    text: str
    tag: str
    near: tuple[str, ...]
    above: frozenset[str]
    link: float


def blocks(page: str | None) -> tuple[list[Block], str]:
    """The leaf blocks of a page in order, and its title.

    An element is its tag, followed by the words of its class, id and role. Character references are decoded and white space
    is one space; blocks without text are left out. Unclosed elements end as a browser would end them, roughly.
    """
    page = page or ""
    stack: list[tuple[str, tuple[str, ...], frozenset[str]]] = []  # tag, nearest telling elements, all words above
    open_: Counter[str] = Counter()
    found: list[Block] = []
    text: list[str] = []
    linked, link_depth, at, title, in_head, ended = 0, 0, 0, "", False, False
    nothing = ("", (), frozenset())

    def flush() -> None:
        nonlocal linked, title
        if text:
            raw = "".join(text)
            whole = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            tag, near, above = stack[-1] if stack else nothing
            if whole and tag == "title":
                title = title or whole
            elif whole and not in_head:
                behind = ended and not open_["article"] and not open_["main"]
                found.append(Block(whole, tag, near, above | _BEHIND if behind else above, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def pop() -> str:
        nonlocal ended
        tag = stack.pop()[0]
        open_[tag] -= 1
        ended = ended or tag in ("article", "main")
        return tag

    for start, end, tag, closing, attrs in Tags(page):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if link_depth:
                linked += len(piece.strip())
        at = end
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                link_depth = 0 if closing else 1
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        link_depth = 0
        if tag == "head":
            in_head = not closing
        elif tag == "body":
            in_head = False
        if closing:
            if open_[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in _EMPTY:
            continue
        if stack and (stack[-1][0] == _CLOSES.get(tag) or stack[-1][0] == "p" and tag in _BLOCKS_END_P):
            pop()
        _, near, above = stack[-1] if stack else nothing
        words = _attribute_words(attrs) if attrs and not attrs.isspace() else ()
        if words or tag not in _WRAPPERS:
            near = (" ".join((tag, *words)), *near[:1])
        said = {f"a={tag}", *(f"c={w}" for w in words)}
        stack.append((tag, near, above if said <= above else above | said))
        open_[tag] += 1
    if at < len(page):
        text.append(page[at:])
    flush()
    return found, title


@lru_cache(1 << 14)
def _attribute_words(attrs: str) -> tuple[str, ...]:
    words = {w for _, a, b, c in _NAMES.findall(attrs) for w in _PART.findall((a or b or c).lower())}
    if _HIDDEN.search(attrs):
        words.add("hidden")
    return tuple(sorted(words))


@lru_cache(1 << 17)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


@lru_cache(1 << 13)
def _place(tag: str, near: tuple[str, ...], above: frozenset[str]) -> tuple[int, ...]:
    """Features of where a block stands: what any ancestor says, and what the nearest ones say."""
    out = {f"own={tag}", *above}
    for up, node in enumerate(near):
        name, *words = node.split()
        out.add(f"t{up}={name}")
        out.update(f"c{up}={w}" for w in words)
    return tuple(map(_bucket, sorted(out)))


def _looks(text: str, tag: str, link: float, title: str) -> list[int]:
    """Features of a block's text."""
    n = len(text)
    size, share = min(n.bit_length(), 11), 0 if link == 0 else 1 if link < 0.5 else 2 if link < 0.95 else 3
    end = "s" if text[-1] in ".!?…" else "c" if text[-1] in ":;," else "o"
    out = [f"len={size}", f"link={share}", f"end={end}", f"{tag} len={size}", f"{tag} link={share}", f"len={size} link={share}"]
    out.append(f"commas={min(4, 400 * text.count(',') // (n + 100))}")
    words = _PART.findall(text.lower())
    told = _WORDS.intersection(words)
    often = min(3, 40 * len(told) // max(1, len(words)))  # a few such words in a long text say little
    out += [f"w{often}={w}" for w in told]
    out.append(f"digits={min(3, 8 * sum(map(str.isdigit, text)) // n)}")
    if "©" in text:
        out.append(f"©={size}")
    if title and (text.startswith(title) or title.startswith(text)):
        out.append("title")
    return list(map(_bucket, out))


def block_features(found: list[Block], title: str) -> list[list[int]]:
    return [[*_place(b.tag, b.near, b.above), *_looks(b.text, b.tag, b.link, title)] for b in found]


class Field:
    """A linear chain over two labels: a weight for each feature, the four steps from label to label, and a start."""

    def __init__(self):
        self.weights, self.step, self.start = np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2)

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], rounds: int = 120, rate: float = 0.3, decay: float = 2e-3) -> Field:
        """Maximises the conditional likelihood of the labels, by gradients from forward and backward sums over all pages at once."""
        n, longest = len(pages), max(len(x) for x, _ in pages)
        page, place, feature = (np.array(c) for c in zip(*((p, t, f) for p, (x, _) in enumerate(pages) for t, fs in enumerate(x) for f in fs)))
        flat = page * longest + place
        length = np.array([len(x) for x, _ in pages])
        mask = np.arange(longest) < length[:, None]
        gold = np.zeros((n, longest), dtype=np.int64)
        for p, (_, y) in enumerate(pages):
            gold[p, : len(y)] = y
        both = mask[:, 1:]
        gold_steps = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
        sums = [np.zeros_like(w) for w in (self.weights, self.step, self.start)]
        for _ in range(rounds):
            score = np.zeros((n, longest, 2))
            score[:, :, 1] = np.bincount(flat, self.weights[feature], minlength=n * longest).reshape(n, longest)
            ahead, back = np.zeros_like(score), np.zeros_like(score)
            ahead[:, 0] = score[:, 0] + self.start
            for t in range(1, longest):
                moved = np.logaddexp(ahead[:, t - 1, :1] + self.step[0], ahead[:, t - 1, 1:] + self.step[1]) + score[:, t]
                ahead[:, t] = np.where(mask[:, t, None], moved, ahead[:, t - 1])
            total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            for t in range(longest - 2, -1, -1):
                later = back[:, t + 1] + score[:, t + 1]
                moved = np.logaddexp(self.step[:, 0] + later[:, :1], self.step[:, 1] + later[:, 1:])
                back[:, t] = np.where(mask[:, t + 1, None], moved, 0)
            chance = np.exp(ahead + back - total[:, None, None])
            pair = np.exp(ahead[:, :-1, :, None] + self.step + (score + back)[:, 1:, None, :] - total[:, None, None, None])
            wrong = np.where(mask, gold - chance[:, :, 1], 0)
            slopes = [
                np.bincount(feature, wrong.ravel()[flat], minlength=BUCKETS) / n - decay * self.weights,
                (gold_steps - (pair * both[:, :, None, None]).sum(axis=(0, 1))) / n - decay * self.step,
                np.array([(gold[:, 0] == k).mean() - chance[:, 0, k].mean() for k in (0, 1)]) - decay * self.start,
            ]
            for w, g, s in zip((self.weights, self.step, self.start), slopes, sums):  # AdaGrad
                s += g * g
                w += rate * g / (np.sqrt(s) + 1e-8)
        return self

    def decode(self, found: list[list[int]]) -> list[int]:
        """The most likely labels, by Viterbi."""
        weights = self.weights
        (same0, to1), (to0, same1) = self.step.tolist()
        if not found:
            return []
        scores = [float(weights[f].sum()) for f in found]
        best0, best1, back = self.start[0], self.start[1] + scores[0], []
        for s in scores[1:]:
            a, b = best0 + same0, best1 + to0
            c, d = best0 + to1, best1 + same1
            back.append((a < b, c < d))
            best0, best1 = max(a, b), max(c, d) + s
        label = int(best1 > best0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def trained(pages: int = TRAIN_PAGES, seed: int = 1) -> Field:
    """A field fitted to labelled pages written from a seed."""
    return Field().fit([_with_labels(page, truth) for page, truth in labelled(pages, seed)])


def _with_labels(page: str, truth: list[tuple[str, bool]]) -> tuple[list[list[int]], list[int]]:
    found, title = blocks(page)
    labels, at = [], 0
    for text, *_ in found:  # both are in page order; a block may hold a few of the written ones
        labels.append(int(truth[min(at, len(truth) - 1)][1]))
        taken = ""
        while at < len(truth) and len(taken) < len(text):
            taken = (taken + " " + truth[at][0]).strip()
            at += 1
    return block_features(found, title), labels


def main_text(page: str | None, field: Field) -> str:
    found, title = blocks(page)
    labels = field.decode([np.array(f) for f in block_features(found, title)])
    return "\n\n".join(b.text for b, keep in zip(found, labels) if keep)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html), read from the whole html.

    The field labels each leaf block as main text or not; main blocks are joined by two line ends. A null or empty html has an
    empty text; ids and urls are handed on as they are, null or repeated. Other columns are not used. An empty table gives an empty
    result.
    """
    python_batches(pages.sparkSession)
    field = field or trained()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), field) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
