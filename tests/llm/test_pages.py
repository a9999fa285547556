"""Pages with furniture under names and in places that the training pages don't have as such."""

import pytest

from tidewire.llm import extraction

PARAGRAPHS = [
    "The harbour authority opened a second basin in the spring of 1987, after nine years of work.",
    "Ships that had waited outside for days could now unload within hours, and rents in the old town rose.",
    "Not everyone was pleased. Fishermen moved their boats to the northern quay.",
    "A report by the council counted 1,204 berths, of which a third stood empty in winter.",
    "In the end the basin paid for itself by 2003, the report said, with 12,500 jobs in the region.",
]
HEADING = "A second basin for the harbour"
INNER = f"<h1>{HEADING}</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MAIN = {
    "role": f'<div role="main">{INNER}</div>', "post": f'<div class="post-body">{INNER}</div>', "story": f'<section class="story">{INNER}</section>', "storytext": f'<div id="storytext" class="storytext storylocation">{INNER}</div>',
    "section": f"<main><section><div>{INNER}</div></section></main>", "deep": "<div>" * 6 + INNER + "</div>" * 6, "bare": INNER, "menu cell": f"<table><tr><td>menu</td><td>{INNER}</td></tr></table>", "article": f"<article>{INNER}</article>",
    "any name": f'<div class="longread-copy"><div class="inner">{INNER}</div></div>',
}
BESIDE = {
    "nothing": "",
    "sidebar": '<div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten things to know</a></li><li><a href="/2">Storm over the coast</a></li></ul></div>',
    "advert": '<div class="advert">Buy two lamps and get one free this week.</div>',
    "widget": '<div id="disqus_thread"><div class="post"><p>I walked past it last week and it looked empty to me.</p></div><div class="post"><p>Great article, thanks for writing it!</p></div></div>',
    "comments": '<div id="comments"><h3>3 comments</h3><div class="c"><p>I think the town should have kept the old quay.</p></div></div>',
}


@pytest.fixture(scope="module")
def field():
    return extraction.trained()


@pytest.mark.parametrize("main", MAIN)
@pytest.mark.parametrize("beside", BESIDE)
def test_article_without_its_surroundings(field, main, beside):
    menu = '<div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Contact us</a></li></ul></div>'
    foot = '<div class="footer"><p>© 2020 Harbour News. All rights reserved.</p></div>'
    page = f"<html><head><title>x</title></head><body>{menu}{MAIN[main]}{BESIDE[beside]}{foot}</body></html>"
    assert extraction.main_text(page, field) == "\n\n".join([HEADING, *PARAGRAPHS])


@pytest.mark.parametrize("talk", ['<div class="talkback"><div class="item"><p>{}</p></div></div>', '<div id="respond"><h3>What readers say</h3><div class="post"><p>{}</p></div></div>', '<section id="isso-thread"><div class="isso-text"><p>{}</p></div></section>'])
def test_what_stands_behind_an_article_is_none_of_it(field, talk):
    """Whatever its names are; in the article itself the same words stay."""
    said = "Nice one, I was there in June."
    page = f"<html><body><article>{INNER}</article>{talk.format(said)}<footer>© 2020 Harbour News</footer></body></html>"
    assert extraction.main_text(page, field) == "\n\n".join([HEADING, *PARAGRAPHS])
    inside = f"<html><body><article>{INNER}<p>{PARAGRAPHS[1]}</p></article></body></html>"
    assert extraction.main_text(inside, field) == "\n\n".join([HEADING, *PARAGRAPHS, PARAGRAPHS[1]])
    two = f"<html><body><article>{INNER}</article><article>{INNER}</article></body></html>"
    assert extraction.main_text(two, field) == "\n\n".join([HEADING, *PARAGRAPHS] * 2)
