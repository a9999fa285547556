import random
import time
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import extraction, hosts, labelled_pages, mixing, packing, quality
from tests.llm.data import DOCS, odd_documents, plain

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def field():
    return extraction.trained(300)


def test_field_learns_held_out_pages(field):
    right = wrong = 0
    for page, truth in labelled_pages.labelled(80, seed=77):
        features, labels = extraction._with_labels(page, truth)
        got = field.decode([np.array(f) for f in features])
        right += sum(a == b for a, b in zip(got, labels))
        wrong += sum(a != b for a, b in zip(got, labels))
    assert right / (right + wrong) > 0.95


def test_viterbi_finds_the_best_path(field):
    from itertools import product

    r = random.Random(3)
    for _ in range(10):
        found = [np.array(r.sample(range(extraction.BUCKETS), 5)) for _ in range(7)]
        fresh = extraction.Field()
        fresh.weights = np.random.default_rng(1).normal(size=extraction.BUCKETS)
        fresh.step, fresh.start = field.step, field.start
        score = lambda y: fresh.start[y[0]] + sum(fresh.weights[f].sum() * k for f, k in zip(found, y)) + sum(fresh.step[a, b] for a, b in zip(y, y[1:]))
        assert tuple(fresh.decode(found)) == max(product((0, 1), repeat=7), key=score)


def test_extraction_of_odd_pages(spark, field):
    page = """<html><head><title>On trade winds and tides</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
    <div class="cookie-notice">We use cookies to improve this site.</div><article><h1>On trade winds and tides</h1><p>First  paragraph &amp; more,&nbsp;with <b>bold
    words</b> in it, and it goes on for a while.<p>Second paragraph is left unclosed, as pages often do.</p><div class="ad">Buy one now!</div></article>
    <section class="comments"><h3>Comments</h3><p>Nice one, thanks.</p></section><footer>&copy; 2024 Example. All rights reserved.</footer></body></html>"""
    want = "On trade winds and tides\n\nFirst paragraph & more, with bold words in it, and it goes on for a while.\n\nSecond paragraph is left unclosed, as pages often do."
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (4, "w", "<p", "x"), (4, "w", "<p", "x"), (5, "z", "<div>" * 3000 + "text" + "</b></p>" * 10, "x"), (6, "q", "<!-- never closed <p>a</p>", "x")]
    got = {(r.page_id, r.url): r for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), field).collect()}
    assert got[1, "u"].text == want and got[1, "u"].n_chars == len(want)
    assert got[2, None].text == "" and got[None, "v"].n_chars == 0 and got[6, "q"].text == ""
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"), field).count() == 0


_trained = lru_cache(1)(extraction.trained)
_PROSE = [
    "The storm of last week brought a great deal of rain to the valley, and the river rose quickly.",
    "Farmers moved their cattle to higher ground, as they had done in 1987, while the town built a wall of sand.",
    "By Friday the water had gone down, and the council met to count what had been lost in the flood.",
    "Nobody was hurt, said the mayor, who thanked all the people that had helped in those long nights.",
]
_AROUND = (
    '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>',
    '<div class="comments"><h3>Comments</h3><div class="comment"><p>I was there that night, and it was much worse than they say here, believe me.</p></div></div>'
    "<footer><p>Copyright 2024 The Valley Paper. All rights reserved. Read our privacy policy and terms, which changed in May, before you write.</p></footer>",
)


@pytest.mark.parametrize(
    "layout",
    ["<article>%s</article>", "<article><div>%s</div></article>", "<article><div><div>%s</div></div></article>", "<article><div><div><div>%s</div></div></div></article>", '<article><div class="entry-content">%s</div></article>',
     '<div class="page"><div class="wrap"><div class="row"><article>%s</article></div></div></div>', '<div id="content">%s</div>', "<table><tr><td>%s</td></tr></table>", "<main>%s</main>", "<div><div>%s</div></div>", "%s"],
)
def test_layouts_give_the_article_and_nothing_else(layout):
    field = _trained()
    for heading in ("<h1>River falls after flood</h1>", ""):
        inner = heading + "".join(f"<p>{p}</p>" for p in _PROSE)
        page = f"<html><head><title>River falls after flood</title></head><body>{_AROUND[0]}{layout % inner}{_AROUND[1]}</body></html>"
        assert extraction.main_text(page, field).split("\n\n") == ["River falls after flood"] * bool(heading) + _PROSE


@pytest.mark.parametrize("left_out", ["nested", "wrapped", "table", "bare"])
def test_a_layout_not_learnt_from_is_still_read(left_out):
    others = [p for k, name in enumerate(n for n in labelled_pages.LAYOUTS if n != left_out) for p in labelled_pages.labelled(60, 30 + k, name)]
    field = extraction.Field().fit([extraction._with_labels(*p) for p in others])
    right = wrong = 0
    for page in labelled_pages.labelled(60, 99, left_out):
        features, truth = extraction._with_labels(*page)
        got = field.decode([np.array(f) for f in features])
        right += sum(g == t for g, t in zip(got, truth))
        wrong += sum(g != t for g, t in zip(got, truth))
    assert right > 0.93 * (right + wrong)


def test_broken_pages_take_time_in_proportion(field):
    for part in ('<a b="', "<p ", "<div></b></p>", "<a b='\">", "<div>", "<!", "<script"):
        began = time.time()
        extraction.main_text("<p>x</p>" + part * (1_000_000 // len(part)), field)
        assert time.time() - began < 20, part


def test_url_rules_and_reputation(spark):
    urls = {
        "http://A.Example.COM/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://x.www.example.com/en/?q": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "https://example.com#x": ("example.com", "", None, "allow"),
        "https://a.net/fr/x?y": ("a.net", "/fr/x", "net/fr/", "block"),
        "https://a.net/french": ("a.net", "/french", None, "allow"),
        "//no.scheme/x": ("", "", None, "allow"),
        "x://É.net/es/": ("É.net", "/es/", "net/es/", "block"),
        "https://bad.org/x://y": ("bad.org", "/x://y", None, "block"),
        "https://sub.new.org/": ("sub.new.org", "/", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(k, u, 7) for k, u in enumerate(urls)] + [(0, next(iter(urls)), 7)]
    outcomes = [("bad.org", 1)] * 40 + [("good.org", 0)] * 60 + [("few.org", 1)] + [(None, 1), ("odd.org", None)]
    out = hosts.judge(spark.createDataFrame(rows, "page_id long, url string, host int"), spark.createDataFrame(outcomes, "host string, bad int"), hosts.RULES)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)
    assert got == sorted([(k, *v) for k, v in enumerate(urls.values())] + [(0, *next(iter(urls.values())))], key=str)
    scores = {r.host: r for r in hosts.reputation(spark.createDataFrame(outcomes, "host string, bad int")).collect()}
    assert scores["few.org"].mean < 1 and scores["few.org"].low < 0.5 < scores["bad.org"].low and scores["good.org"].mean < 0.2
    empty = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, bad int")
    assert hosts.judge(*empty, hosts.RULES).count() == 0
    assert hosts.judge(spark.createDataFrame(rows, "page_id long, url string, host int"), empty[1], hosts.RULES).where("verdict = 'block'").count() == 4


def test_reputation_decides_where_hosts_differ(spark):
    pages, docs, labels = [], [], []
    for k in range(300):
        host = ["good.org", "fair.net", "spam.info", "www.spam.info", "new.spam.info"][k % 5]
        bad = int(k % 10 == 0) if k % 5 < 2 else int(k % 7 != 0)
        docs.append((k, f"Text {k} of a page &c."))
        labels.append((k, 1 - bad))
        tag = ["article", "main", "body"][k % 3]
        pages.append((k, f"https://{host}/{k}", f"<html><{tag}><h1>Head</h1><p>Text {k} of a\n page &amp;c.</p></{tag}></html>"))
    pages += [(900, "https://good.org/", "<article></article>"), (901, "https://good.org/", None)]
    docs += [(900, " "), (901, None)]
    tables = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (900, 0), (901, 0)], "doc_id long, quality int")
    outcomes = hosts.outcomes_by_text(*tables)
    assert sum(r.n for r in outcomes.collect()) == 300
    found = {r.host: (r.verdict, r.bad_mean, r.bad_low) for r in hosts.judge(tables[0], outcomes, []).collect()}
    assert {h for h, (v, *_) in found.items() if v == "block"} == {"spam.info", "www.spam.info", "new.spam.info"}
    assert all(low < mean for _, mean, low in found.values())
    assert hosts.judge(tables[0], outcomes.where("false"), []).where("verdict = 'block'").count() == 0


def test_quality_separates_and_uses_no_held_out_labels(spark):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choices("abcdefg", k=r.randint(2, 7))) for _ in range(60)) + "."
    rows = [(k, good() if k % 5 else " | ".join(good().upper().split()) + "!! $$$") for k in range(600)]
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in rows] + [(None, None, None, "x"), (9001, "", None, "x"), (3, rows[3][1], None, "x"), (9002, "word " * 30000, None, "x")], "doc_id long, text string, held_out string, score string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(500)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == 604 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    held = [x for x in got if x.doc_id is not None and x.doc_id < 600 and x.held_out]
    assert sum(x.predicted == (x.doc_id % 5 > 0) for x in held) / len(held) > 0.95
    flipped = spark.createDataFrame([(k, int(k % 5 > 0) if zlib.crc32(str(k).encode()) % 5 else 1 - int(k % 5 > 0), 0) for k in range(500)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    again = {x.doc_id: x.score for x in quality.scored(docs, flipped).collect() if x.doc_id}
    assert all(again[x.doc_id] == x.score for x in got if x.doc_id)
    none = labels.where("false")
    assert {x.score for x in quality.scored(docs, none).collect()} == {0.5}
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.scored(docs.where("false"), labels).count() == 0


def test_class_prior_is_near_the_truth():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    unlabelled = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-3, 1, 1200)])
    assert abs(quality.class_prior(positive, unlabelled) - 0.7) < 0.06


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]] if total else []
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.remove(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())


def test_mix_meets_targets(spark):
    docs = odd_documents(spark, 120)
    rows = plain(docs)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split(None)) if (t or "").isascii() else len([w for w in (t or "").replace("\n", " ").split(" ") if w])
    want = expected_targets(dict(sizes))
    got = mixing.taken_words(docs, block_words=16, shard_slots=64).collect()
    again = mixing.taken_words(docs.repartition(7), block_words=16, shard_slots=64).collect()
    key = lambda r: (str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    assert all(r.taken <= 2 * r.size for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert set(taken) == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (size, target), n in taken.items():
        assert abs(n - target) <= max(32, 0.02 * target)
    assert mixing.taken_words(spark.createDataFrame([], DOCS)).count() == 0


def test_draws_use_up_quotas_by_permutations(spark):
    r = random.Random(5)
    sources = [(i, r.choice([1, 2, 3, 7, 40, 333]), 0) for i in range(30)]
    sources = [(i, b, r.randint(0, 2 * b)) for i, b, _ in sources] + [(30, 900, 1500)]
    table = spark.createDataFrame(sources, "idx int, blocks long, quota long")
    got = mixing.draws(table, sum(q for *_, q in sources), len(sources), 100, 3).collect()
    times = defaultdict(lambda: defaultdict(int))
    for x in got:
        times[x.idx][x.block] += 1
    per_shard = defaultdict(int)
    for x in got:
        per_shard[x.shard] += 1
    total = sum(q for *_, q in sources)
    assert all(n == min(100, total - 100 * s) for s, n in per_shard.items()) and len(got) == total
    for i, b, q in sources:
        assert sum(times[i].values()) == q and set(times[i]) <= set(range(b))
        assert all(times[i].get(k, 0) in (q // b, -(-q // b)) for k in range(b))


def test_permutations_are_one_to_one(spark):
    for n in (1, 2, 3, 5, 16, 17, 101, 1000):
        got = [x.p for x in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9)).alias("p")).collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != list(range(n)))


def test_mixed_documents_hold_the_words_taken(spark):
    docs = odd_documents(spark).where("doc_id IS NOT NULL AND doc_id != 2")
    options = dict(block_words=16, shard_slots=64)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs, **options).collect()}
    out = mixing.mixed_documents(docs, **options)
    assert out.schema == docs.schema
    words, texts = defaultdict(int), {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        words[r.doc_id] += len(r.text.replace("\n", " ").split(" ")) if "  " not in r.text else len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id].split()) and r.n_chars == len(r.text)
    assert all(abs(words[i] - n) <= 2 for i, n in taken.items()) or {i: words[i] for i in taken} == taken
    assert mixing.mixed_documents(spark.createDataFrame([], DOCS), **options).count() == 0


def test_packing_round_trip(spark):
    docs = odd_documents(spark)
    tokenizer = Tokenizer.from_file(PATH)
    for capacity in (64, 4096):
        got = packing.pack(docs, PATH, capacity=capacity).collect()
        want = []
        for i, t, _ in plain(docs):
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
            want += [(str(i), k, k * capacity, len(c := ids[k * capacity : (k + 1) * capacity]), zlib.crc32(c.tobytes())) for k in range(-(-len(ids) // capacity))]
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for items in bins.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) <= 1.03 * -(-sum(w[3] for w in want) // capacity) + 2
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_tight(seed):
    r = np.random.default_rng(seed)
    capacity = 4096
    lengths = r.integers(1, capacity + 1, 3000) if seed % 2 else np.minimum(capacity, r.lognormal(6, 1, 3000).astype(int) + 1)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.best_plan(histogram, capacity)
    ranks, filled = defaultdict(list), defaultdict(list)
    for size, first, items, bin_, offset in plan.runs:
        ranks[size] += range(first, first + items)
        for k in range(items):
            filled[bin_ + k].append((offset, size))
    assert {s: sorted(v) for s, v in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
    for items in filled.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity
    # Nothing can beat the volume, nor the number of items over half the capacity.
    least = max(-(-int(lengths.sum()) // capacity), int((lengths > capacity / 2).sum()))
    assert len(filled) <= 1.02 * least + 2
