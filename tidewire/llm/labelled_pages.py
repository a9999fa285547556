"""Labelled web pages to train extraction on, written by rules from a seed."""

from __future__ import annotations

import html
import random

_SYLLABLES = ["an", "ber", "cho", "de", "el", "fin", "gra", "he", "in", "jo", "ka", "lo", "mi", "nes", "or", "pa", "qui", "re", "sta", "ti", "un", "vo", "wer", "ze", "é", "ü", "ñ", "th", "ing", "tion"]
_NOISE = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "topnav", "links"],
    "header": ["header", "masthead", "banner", "site-header", "topbar", "logo"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "trending", "rail"],
    "notice": ["notice", "cookie", "consent", "alert", "gdpr", "paywall", "message"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"],
    "form": ["newsletter", "subscribe", "signup", "login", "search", "contact-form"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "disqus", "disqus_thread", "user-comments", "reactions", "responses", "thread", "feedback"],
    "share": ["share", "social", "toolbar", "sharing"],
}
_MAIN = ["content", "post", "post-body", "post-content", "entry", "entry-content", "article-body", "story", "main", "text", "body-copy"]
#: What holds one reader's comment; some of it also names main text.
_COMMENT = ["comment", "comment-body", "comment-text", "reply", "post", "message", "bubble"]
_PHRASES = {
    "footer": ["All rights reserved", "Privacy policy", "Terms of use"],
    "notice": ["We use cookies", "Accept all cookies", "Subscribe to read on"],
    "ad": ["Advertisement", "Sponsored content"],
    "form": ["Subscribe to our newsletter", "Your e-mail", "Sign in", "Search"],
    "comments": ["Leave a reply", "Comments", "Log in to reply"],
    "aside": ["Related articles", "Most read"],
}


#: Where the main text of a page stands.
LAYOUTS = ["semantic", "nested", "named", "wrapped", "table", "plain", "bare"]


class Page:
    """Markup as it grows, with the blocks in order, each with whether it is main text."""

    def __init__(self, seed: int, layout: str | None = None):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.truth: list[tuple[str, bool]] = []
        self.plain = self.r.random() < 0.3  # class names that say nothing
        self.told = False  # whether a semantic article has ended
        self.layout = layout or self.r.choices(LAYOUTS, [5, 3, 3, 2, 1, 1, 2])[0]

    def words(self, n: int) -> str:
        r = self.r
        word = lambda: str(r.choice([r.randint(0, 99), r.randint(1900, 2030), f"{r.randint(1, 999)},{r.randint(100, 999)}"])) if r.random() < 0.03 else "".join(r.choices(_SYLLABLES, k=r.randint(1, 3)))
        text = " ".join(word() + ("," if r.random() < 0.07 else "") for _ in range(n))
        return text[:1].upper() + text[1:]

    def sentence(self) -> str:
        return self.words(self.r.choice([1, 2, 4, 8, 12, 18])) + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 14])))
        if self.r.random() < 0.1:
            text = " ".join(w + self.r.choice(["&&&", "###", "%%%", " |", "!!"]) for w in text.split())
        return text.upper() if self.r.random() < 0.03 else text

    def names(self, kinds: list[str], vague: float = 0.8) -> str:
        if self.told and self.r.random() < 0.3:  # behind an article that has ended, names needn't tell
            return self.any_name()
        if self.plain and self.r.random() < vague:
            return "".join(self.r.choices("abcdefgxyz", k=5))
        return self.r.choice(kinds)

    def any_name(self) -> str:
        r = self.r
        return "-".join("".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(3, 8))) for _ in range(r.randint(1, 2)))

    def put(self, tag: str, text: str, main: bool, link: bool = False) -> None:
        inner = html.escape(text, quote=False)
        if link:
            inner = f'<a href="/{self.r.randint(1, 999)}">{inner}</a>'
        elif self.r.random() < 0.15:
            inner = self.r.choice(["<b>{}", "<em>{}</em>", "<span>{}</span>", "{}<br>"]).format(inner)
        self.out.append(f"<{tag}>{inner}" + ("" if tag in ("p", "li") and self.r.random() < 0.2 else f"</{tag}>"))
        self.truth.append((" ".join(text.split()), main))

    def noise(self, kind: str) -> None:
        r = self.r
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        tag = tag if r.random() < 0.6 and kind != "form" else "form" if kind == "form" else "div"
        self.out.append(f'<{tag} {r.choice(["class", "class", "id"])}="{self.names(_NOISE[kind], 0.4 if kind == "comments" else 0.8)}">')
        if kind in ("nav", "share") or (kind in ("aside", "footer", "header") and r.random() < 0.6):
            if r.random() < 0.4 and kind == "aside":
                self.put("h3", r.choice(_PHRASES["aside"]), False)
            self.out.append("<ul>")
            for _ in range(r.randint(2, 8)):
                self.put("li", self.words(r.randint(1, 6)), False, link=True)
            self.out.append("</ul>")
        elif kind == "comments":
            self.put("h3", r.choice(_PHRASES["comments"]), False)
            for _ in range(r.randint(1, 8)):
                self.out.append(f'<div class="{self.names(_COMMENT, 0.5)}">')
                self.put("div" if r.random() < 0.05 else "p", self.prose(), False)
                self.out.append("</div>")
        elif kind == "form":
            self.put("label", r.choice(_PHRASES["form"]), False)
            self.out.append('<input type="text" name="q">')
            self.put("button", r.choice(_PHRASES["form"]), False)
        else:
            extra = r.choice(_PHRASES.get(kind, [""])) if r.random() < 0.5 else ""
            text = ("© " if kind == "footer" and r.random() < 0.6 else "") + " ".join(x for x in (extra, *(self.sentence() for _ in range(r.choice([1, 1, 2, 4])))) if x)
            self.put("p", text, False) if r.random() < 0.4 else self._bare(text)
        self.out.append(f"</{tag}>")

    def _bare(self, text: str) -> None:
        self.out.append(html.escape(text, quote=False))
        self.truth.append((" ".join(text.split()), False))

    def article(self) -> str:
        """The main text in one of LAYOUTS: its container, if any, is told from furniture by its tag, its names or its text alone."""
        r = self.r
        outer, shut = self.container()
        title = self.sentence()
        heading, inside = r.random() < 0.75, r.random() < 0.8
        if heading and not inside:
            self.put("h1", title, True)
        self.out.append(outer)
        if heading and inside:
            self.put("h1", title, True)
        for _ in range(r.choice([1, 2, 4, 4, 7, 12, 20])):
            kind = r.random()
            deep = r.choice([0, 0, 0, 1, 2]) if r.random() < 0.15 else 0
            self.out.append("<div>" * deep)
            if kind < 0.74:
                self.put("p", self.prose(), True)
            elif kind < 0.80:
                self.put(r.choice(["h2", "h3"]), self.words(r.randint(2, 7)), True)
            elif kind < 0.85:
                self.out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.put("li", self.sentence(), True, link=r.random() < 0.1)
                self.out.append("</ul>")
            elif kind < 0.88:
                self.put(r.choice(["blockquote", "pre", "figcaption", "td"]), self.prose(), True)
            elif kind < 0.95:
                self.noise(r.choice(["ad", "ad", "aside", "form", "notice", "share"]))
            else:
                self.put("div", self.prose(), True)
            self.out.append("</div>" * deep)
        if r.random() < 0.25:
            self.noise("comments")
        self.out.append(shut)
        return title

    def container(self) -> tuple[str, str]:
        r, layout = self.r, self.layout
        named = f' {r.choice(["class", "class", "id"])}="{self.any_name() if r.random() < 0.35 else self.names(_MAIN)}"'
        deep = r.randint(1, 4)
        if layout == "semantic":
            tag = r.choice(["article", "article", "main"])
            return f"<{tag}{r.choice(['', named])}>", f"</{tag}>"
        if layout == "nested":
            tag = r.choice(["article", "main", "article"])
            return f"<{tag}>" + "<div>" * deep, "</div>" * deep + f"</{tag}>"
        if layout == "named":
            tag = r.choice(["div", "div", "section"])
            within = "".join(f'<div class="{self.any_name()}">' if r.random() < 0.4 else "<div>" for _ in range(deep - 1))
            return f"<{tag}{named}>" + within, "</div>" * (deep - 1) + f"</{tag}>"
        if layout == "wrapped":
            return "".join(f'<div class="{self.names(["page", "wrapper", "container", "layout", "row", "col"])}">' for _ in range(deep)) + "<article>", "</article>" + "</div>" * deep
        if layout == "table":
            if r.random() < 0.6:  # a menu or a notice in a cell of its own
                self.out.append("<table><tr>")
                for _ in range(r.randint(1, 3)):
                    self.out.append("<td>")
                    self._bare(self.words(r.randint(1, 3)))
                    self.out.append("</td>")
                return f"<td{r.choice(['', named])}>", "</td></tr></table>"
            return f"<table><tr><td{r.choice(['', named])}>", "</td></tr></table>"
        if layout == "plain":
            return "<div>" * deep, "</div>" * deep
        return "", ""  # bare: straight in the body

    def whole(self) -> str:
        r = self.r
        self.out = []
        for kind, chance in (("notice", 0.3), ("header", 0.5), ("nav", 0.85), ("ad", 0.5), ("aside", 0.15)):
            if r.random() < chance:
                self.noise(kind)
        wrapped = r.random() < 0.4
        if wrapped:
            self.out.append(f'<div class="{self.names(["page", "wrapper", "container", "layout"])}">')
        title = self.article()
        self.told = self.layout in ("semantic", "nested", "wrapped")
        for kind, chance in (("share", 0.2), ("aside", 0.4), ("comments", 0.3), ("form", 0.3), ("notice", 0.15)):
            if r.random() < chance:
                self.noise(kind)
        if wrapped:
            self.out.append("</div>")
        if r.random() < 0.9:
            self.noise("footer")
        head = f"<head><title>{html.escape(title[:60])}</title><style>p{{margin:0}}</style><script>var t=1;</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(self.out)}</body></html>"


def labelled(n: int, seed: int = 0, layout: str | None = None) -> list[tuple[str, list[tuple[str, bool]]]]:
    """n pages as (html, blocks with whether they are main text), all of one layout if it is named."""
    pages = [Page(seed * 100_003 + k, layout) for k in range(n)]
    return [(p.whole(), p.truth) for p in pages]
