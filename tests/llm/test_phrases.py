"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import DOCS, odd_documents
from tidewire.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            own.update(tuple(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(100 * c >= 50 * a and c >= least for q, c in f.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), left, right))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k + 1, phrase, a, left, right, n, score) for k, (score, a, phrase, left, right) in enumerate(found[:top])]
    return sorted(out, key=str)


def texts(r, n):
    some = ["New", "york", "city", "of", "The", "the", "und", "der", "é", "漢字", "a", "b"]
    weights = [9, 9, 6, 20, 20, 20, 5, 5, 2, 2, 3, 3]
    return [r.choice(["", " ", "x, "]) + "".join(w + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b"]) for w in r.choices(some, weights, k=r.choice([0, 1, 2, 40, 200]))) for _ in range(n)]


@pytest.mark.parametrize("heavy,entries,flush", [(1 << 13, 1 << 21, 1 << 22), (40, 1 << 21, 300), (12, 8, 1000)])
def test_collocations_are_those_of_a_plain_count(spark, monkeypatch, heavy, entries, flush):
    """Whole stripes; stripes split in blocks; stripes passed on in parts."""
    monkeypatch.setattr(phrases, "HEAVY", heavy)
    monkeypatch.setattr(phrases, "ENTRIES", entries)
    monkeypatch.setattr(phrases, "FLUSH", flush)
    r = random.Random(heavy)
    rows = [(r.choice(["en", "en", "de", None]), t) for t in texts(r, 60)] + [("xx", None), ("en", ""), ("en", "the of. " * 500), ("en", "the of. " * 500)]
    docs = spark.createDataFrame([(*x, 1, "clash") for x in rows], "lang string, text string, n long, phrase string").repartition(5)
    for least, top in ((3, 2000), (10, 7)):
        assert sorted((tuple(x) for x in phrases.collocations(docs, least=least, top=top).collect()), key=str) == plain(rows, least, top)


def test_collocations_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(x.lang, x.text) for x in docs.collect()]
    expected = plain(rows, 5, 2000)
    assert expected and sorted((tuple(x) for x in phrases.collocations(docs, least=5).collect()), key=str) == expected
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(3_000_000_001, 3_000_000_019, 3_000_000_037), (10**12, 10**12, 10**12 + 1)], "a long, l long, r long")
    got = [x[0] for x in big.select(phrases._score("a", "l", "r")).collect()]
    assert sorted(got) == sorted([1000000 * 3_000_000_001**2 // (3_000_000_019 * 3_000_000_037), 1000000 * 10**24 // (10**12 * (10**12 + 1))])


def test_texts_are_held_over_batches():
    """Small batches don't give small flushes: all texts of a language below FLUSH are one, and very many languages are handed over in time."""
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array(["A b.", None, "c\td"])], names=["lang", "text"])
    assert list(phrases._flushes([batch] * 3)) == [("en", b"\n".join([b"a b\n", b"c d"] * 3))]
    many = [pa.RecordBatch.from_arrays([pa.array([f"l{k}"]), pa.array(["a b " * (phrases.FLUSH // 8)])], names=["lang", "text"]) for k in range(20)]
    found = [lang for lang, _ in phrases._flushes(iter(many[:8]))]
    assert sorted(found) == sorted(f"l{k}" for k in range(8))
    seen = iter(many)
    next(phrases._flushes(seen))
    assert len(list(seen)) == 12  # 8 halves of FLUSH were held, not all 20


@pytest.mark.parametrize("entries,chunk", [(1 << 21, 1 << 20), (1 << 21, 7), (40, 7), (3, 1)])
@pytest.mark.parametrize("rows_a_batch", [1, 4, 1000])
def test_merged_stripes_hold_all_occurrences(monkeypatch, entries, chunk, rows_a_batch):
    """Prefix sums of the merged rows are the counts, wherever batches and chunks cut a stripe."""
    monkeypatch.setattr(phrases, "ENTRIES", entries)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    r = random.Random(chunk)
    docs = [(lang, t) for t in texts(r, 40) for lang in ("en", "de")]
    blocks = {b"the": 3, b"of": 2}
    parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs[k : k + 20])], names=["lang", "text"]) for k in range(0, len(docs), 20)]
    held = pa.Table.from_batches([b for p in parts for b in phrases._stripes(blocks)([p])])
    held = held.sort_by([(k, "ascending") for k in ("lang", "w1", "block")]).combine_chunks()
    found = Counter()
    for batch in phrases._merged(blocks, 3)(held.to_batches(max_chunksize=rows_a_batch)):
        for lang, w1, w2, w3, n in zip(*(c.to_pylist() for c in batch.columns)):
            for key in {(lang, w1), (lang, w1, w2), (lang, w1, w2, w3)}:
                found[key] += n if None not in key else 0
    expected = Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text.translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            expected.update((lang, *ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    frequent = {k: n for k, n in expected.items() if n >= 3 or len(k) == 2}
    assert {k: found[k] for k in frequent} == frequent


def test_triples_of_very_many_words():
    """Counts agree where three numbers fill more than 63 bits."""
    one, two, three = (np.array(x) for x in ([5, 5, 9, 5], [1, 1, 0, 1], [7, 7, 0, 2]))
    for n in (10, 1 << 22):
        assert [x.tolist() for x in phrases._triples(one, two, three, n)] == [[5, 5, 9], [1, 1, 0], [2, 7, 0], [1, 2, 1]]
    assert [len(x) for x in phrases._triples(one[:0], two[:0], three[:0], 2)] == [0] * 4
