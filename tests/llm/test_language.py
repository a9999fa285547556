"""Language-model scores and the filter audit against brute force."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.data import DOCS, odd_documents
from tidewire.llm import audit, ppm

WHITE = " \t\n\r\x0b\x0c"


def words(text):
    return (text or "").translate(str.maketrans({c: " " for c in WHITE})).split(" ") if text else []


class PlainPpm:
    """The model by its definition: sets of symbols, excluded one by one."""

    def __init__(self, texts, order):
        self.order, self.top = order, Counter()
        for t in texts:
            self.top.update(self.grams(t))
        self.levels = {order: Counter(self.top)}
        for k in range(order - 1, -1, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.contexts = {k: defaultdict(dict) for k in self.levels}
        for k, counts in self.levels.items():
            for g, n in counts.items():
                self.contexts[k][g[:-1]][g[-1]] = n

    def grams(self, text):
        s = [256] * self.order + list((text or "").encode().lower()) + [257]
        return [tuple(s[i : i + self.order + 1]) for i in range(len(s) - self.order)]

    def p(self, gram):
        context, b, gone, p = gram[:-1], gram[-1], set(), 1.0
        for k in range(self.order, -1, -1):
            known = self.contexts[k].get(context[len(context) - k :], {})
            left = {s: n for s, n in known.items() if s not in gone}
            room = 2 * sum(left.values())
            if b in left:
                return p * (2 * left[b] - 1) / room
            if left:
                p *= len(left) / room
            gone |= set(known)
        return p / (257 - len(gone))

    def score(self, text):
        return sum(math.log10(self.p(g)) for g in self.grams(text))


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain_scores(rows, order):
    trained = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    model, c = PlainPpm(trained, order), Counter()
    for t in trained:
        c.update([w for w in words(lower(t)) if w] + [None])
    total, types = c.total(), len(c)
    out = []
    for i, t in rows:
        tokens = [w for w in words(lower(t)) if w] + [None]
        base = sum(math.log10((c[w] + 1) / (total + types + 1)) for w in tokens)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(c[w] > 0 for w in tokens), total, base, model.score(t)))
    return out


def close(found, expected):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6), round(r[6], 6))
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order,heavy", [(3, 1 << 22), (2, 40), (5, 1)])
def test_scores_are_those_of_the_plain_model(spark, monkeypatch, order, heavy):
    """With all grams and words at the workers, with a part of them, and with none."""
    monkeypatch.setattr(ppm, "HEAVY_GRAMS", heavy)
    monkeypatch.setattr(ppm, "HEAVY_WORDS", heavy)
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    close(ppm.scored(docs, order=order).collect(), plain_scores(rows, order))


def test_probabilities_of_a_context_sum_to_one():
    model = PlainPpm(["abracadabra", "abc", None, "bra bra"], 3)
    for context in [(256, 256, 256), tuple(b"abr"), tuple(b"xyz"), (256, 256, 97), tuple(b"zra")]:
        assert sum(model.p((*context, s)) for s in [*range(256), 257]) == pytest.approx(1.0)


def test_scores_of_empty_tables_and_without_training(spark):
    assert ppm.scored(spark.createDataFrame([], DOCS)).collect() == []
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    found = ppm.scored(spark.createDataFrame([(ids[0], "Ab", "en", "s", 2, 0, "x", 0.0), (ids[1], None, "en", "s", 0, 0, "x", 0.0)], DOCS)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in sorted(found, key=lambda r: -r.n_tokens)] == [(2, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert sorted(r.score for r in found) == pytest.approx([-3 * math.log10(257), -math.log10(257)])


@given(st.lists(st.integers(0, 3000), unique=True), st.lists(st.integers(0, 3000), unique=True))
def test_galloping_sets(a, b):
    x, y = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    assert audit.places(x, y).tolist() == np.searchsorted(y, x).tolist()
    assert audit.union(x, y).tolist() == sorted({*a, *b})
    assert x[audit.among(x, y)].tolist() == sorted({*a} & {*b})


def plain_audit(rows, labels):
    texts = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""].append(i)
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        ws = [w for w in words(t) if w]
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and i > min(texts[t])
        good, toxic = (any(x[k] == 1 for x in labels.get(i, [])) for k in (0, 1))
        parts[lang or ""].append(("".join(f for f in "ABCDE" if fails[f]), good, toxic))
    out = []
    for part, own in parts.items():
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                gone = [x for x in own if f in x[0] and not set(order[:k]) & set(x[0])]
                removed[order, f] = len(gone)
                kept = sum(not set(order[: k + 1]) & set(x[0]) for x in own)
                redundant = sum(f in x[0] for x in own) - len(gone)
                out.append([part, order, k + 1, kept, len(gone), redundant, sum(x[0] == f for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)])
        for r in out:
            if r[0] == part:
                r.append(sum(n for (_, f), n in removed.items() if f == r[1][r[2] - 1]))
    return sorted(map(tuple, out))


def test_audit_is_that_of_a_plain_loop(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in odd_documents(spark).collect()]
    rows += [(200 + k, f"Some TEXT in CAPITALS # {k % 3}", "en") for k in range(9)] + [(300, "a b " * 200, "a|b"), (301, "a b " * 200, None)]
    labels = {3: [(1, 0)], 40: [(1, 1), (0, 0)], 201: [(None, 1)], 44: [(1, None)], 205: [(1, 0)]}
    docs = spark.createDataFrame([(*r, "clash", True) for r in rows], "doc_id long, text string, lang string, part string, A boolean").repartition(3)
    table = spark.createDataFrame([(i, *x) for i, xs in labels.items() for x in xs], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, audit.filter_audit(docs, table).collect())) == plain_audit(rows, labels)
    assert audit.filter_audit(docs.limit(0), table).collect() == []


def test_posting_lists_hold_the_rows_that_fail(spark):
    rows = [(p, i if i % 5 else None, 10 * i, i % 2 == 0, None if i % 3 else True) for p in ("x", "") for i in range(50)]
    lists = audit.posting_lists(spark.createDataFrame(rows, "part string, doc_id long, row long, even boolean, third boolean"), ["even", "third"]).collect()
    for p in ("x", ""):
        own = [r for r in lists if r.part == p]
        assert (sum(r.size for r in own), sum(len(r.even) for r in own), sum(len(r.third) for r in own)) == (50, 25, 17)
        assert all(r.even == sorted(set(r.even)) for r in own)
        assert len({n for r in own for n in r.even} & {n for r in own for n in r.third}) == 9
