"""Byte shards against a plain version."""

import zlib

import pytest
import xxhash

from tests.llm.data import DOCS, odd_documents
from tidewire.llm import sharding


def signed(text):
    if text is None:
        return 42  # the seed
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def plain(rows, shards, uneven=0.01):
    order = sorted(((signed(t), i is not None, i or 0, len((t or "").encode()) + 1, t, i) for i, t in rows), key=lambda r: r[:4])
    total, at, placed, spans = sum(r[3] for r in order), 0, [], {}
    for h, _, _, size, t, i in order:
        placed.append((i, t, h, size, at))
        lo, _ = spans.get(h, (at, 0))
        at += size
        spans[h] = (lo, at)
    cuts = []
    for k in range(1, shards):
        target = total * k / shards
        lo, hi = next(((lo, hi) for lo, hi in spans.values() if lo < target < hi), (target, target))
        near = min(target - lo, hi - target)
        cuts.append((lo if target - lo <= hi - target else hi) if near <= total / shards * uneven else target)
    out, used, slots = [], {}, {}
    for i, t, h, size, at in placed:
        shard = sum(at + size / 2 >= c for c in cuts)
        slot = slots[shard] = slots.get(shard, -1) + 1
        used[shard] = used.get(shard, 0) + size
        out.append((i, size, None if t is None else zlib.crc32(t.encode()), shard, slot, any(spans[h][0] < c < spans[h][1] for c in cuts)))
    return sorted(((*r[:5], used[r[3]], r[5]) for r in out), key=str)


def found(docs, *args):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.shard_bytes, r.group_cut) for r in sharding.shard_by_bytes(docs, *args).collect()), key=str)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_those_of_the_plain_version(spark, shards):
    docs = odd_documents(spark).repartition(5)
    assert found(docs, shards) == plain([(r.doc_id, r.text) for r in docs.collect()], shards)


@pytest.mark.parametrize("copies,uneven", [(60, 0.01), (60, 0.4), (900, 0.01), (900, 0.4), (900, 1.0)])
def test_a_group_stays_whole_where_the_balance_allows(spark, copies, uneven):
    """Small and large groups of equal texts, on both sides of the measure."""
    rows = [(k, "the same text in every one of them") for k in range(copies)] + [(1000 + k, f"text {k} of its own, some letters long") for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain(rows, 4, uneven)
    assert found(docs, 4, "text", "doc_id", uneven) == expected
    torn = {r[-1] for r in expected if r[0] < 1000}
    assert len(torn) == 1
    if torn == {False}:
        assert len({r[3] for r in expected if r[0] < 1000}) == 1
    share = sum(r[1] for r in expected) / 4
    assert all(abs(r[5] - share) <= 2 * uneven * share + max(x[1] for x in expected) for r in expected)


def test_shards_of_an_empty_table(spark):
    assert found(spark.createDataFrame([], DOCS), 4) == []
