import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewire.llm import components, embeddings, fmindex, sharding, simhash, sketches, substrings
from tidewire.llm.common import forest
from tests.llm.data import DOCS, odd_documents, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reach(nodes, linked):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_forest_and_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (30, 20), (200, 150), (200, 400)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        want = reach(range(n), zip(i.tolist(), j.tolist()))
        assert forest(i, j, n).tolist() == [want[k] for k in range(n)]
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(1, 1), (None, 3)] + [(k, k + 1) for k in range(400, 430)]
    want = reach({x for p in pairs for x in p if x is not None}, [p for p in pairs if None not in p])
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[n] == c for n, c in want.items() if n in got) and {n for n, c in want.items() if c != n} <= set(got)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(found)] if 0 < len(found) < 3 else [" ".join(found[k : k + 3]) for k in range(len(found) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_matches_brute_force(spark):
    docs = odd_documents(spark)
    rows = plain(docs)
    prints = {fingerprint(t) for _, t, _ in rows}
    roots = reach(prints, [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 2])
    smallest = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            smallest[roots[fingerprint(t)]].append(i)
    want = sorted((str(i), f"{fingerprint(t):016x}", min(smallest[roots[fingerprint(t)]], default=None)) for i, t, _ in rows)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id").collect()
    assert sorted((str(r.doc_id), r.f, r.component_id) for r in got) == want
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0 and simhash.one_of_similar(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_links_are_whole_for_any_allocation(spark, parts):
    r = np.random.default_rng(parts)
    base = r.integers(-(2**63), 2**63, 60, dtype=np.int64)
    near = np.concatenate([base ^ (np.int64(1) << r.integers(0, 62, 60)) ^ (np.int64(1) << r.integers(0, 62, 60)) for _ in range(4)])
    fps = sorted({int(x) for x in np.concatenate([base, near])})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = reach(fps, [(a, b) for a in fps for b in fps if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    got = {x.node: x.component for x in components.connected_components(simhash.fingerprint_links(df, 2, parts, tile_rows=16)).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())


def test_allocation_is_least_cost_and_sums_to_its_budget():
    costs = [[0, 5, 50, 500], [0, 1, 2, 900], [0, 7, 90, 800]]
    t = simhash.allocate(costs, 0)
    assert sum(t) == 0 and t == [0, 1, -1] and simhash.allocate([[0, 1, 1, 1]], 2) == [2]


def test_embeddings_match_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(20, 16))
    rows = []
    for k in range(160):
        v = base[k % 20] + r.normal(scale=r.choice([0.01, 0.1, 0.25]), size=16)
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3), "x"))
    rows += [(200 + k, rows[1][1], 1, "x") for k in range(30)] + [rows[7], rows[7]]
    rows += [(300, None, 1, "x"), (301, [0.0] * 16, 1, "x"), (302, [None] + [1.0] * 15, 1, "x"), (303, [float("nan")] * 16, 1, "x"), (304, rows[1][1], None, "x"), (305, [], 1, "x"), (306, [1.0, 2.0], 1, "x"), (307, [float(2 * x) for x in rows[1][1]], 1, "x"), (308, [float("inf")] + [1.0] * 15, 1, "x")]
    schema = "vec_id long, embedding array<float>, label int, node string"
    stored = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab, _ in rows]
    good = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return a @ b / np.sqrt((a @ a) * (b @ b))

    links, pairs = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(len(rows)):
            (i, v, x), (j, w, y) = stored[a], stored[b]
            if a != b and x is not None and x == y and good(v) and good(w) and len(v) == len(w) and cosine(v, w) >= 0.93:
                links[a] += 1
                pairs.append((i, j))
    roots = reach({i for i, _, _ in stored}, pairs)
    want = sorted((i, links[k], roots[i], roots[i] == i) for k, (i, _, _) in enumerate(stored))
    for tile in (8, 1024):
        got = embeddings.near_duplicates(spark.createDataFrame(rows, schema), 0.93, tile_rows=tile).collect()
        assert sorted((g.vec_id, g.n_links, g.component_id, g.kept) for g in got) == want
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    null_id = embeddings.near_duplicates(spark.createDataFrame([(None, rows[1][1], 1, "x"), rows[1]], schema)).collect()
    assert sorted(((g.vec_id, g.n_links, g.kept) for g in null_id), key=str) == sorted([(None, 0, False), (1, 0, True)], key=str)


def test_quantisation_bound_holds():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embeddings.quantise(x)
    near = (q.astype(float) * s[:, None]) @ (q.astype(float) * s[:, None]).T
    assert (np.abs(x @ x.T - near) <= e[None, :] + e[:, None] * (1 + e[None, :]) + 1e-12).all()


def without(rows):
    """(kept words, number of words) of each row, by the definition: windows in order of id, text and place."""
    order = sorted(set((i if i is not None else 2**63 - 1, zlib.crc32((t or "").encode()), t or "") for i, t, _ in rows))
    seen, kept = set(), {}
    for i, _, t in order:
        found = WORD.findall(t)
        keep = [True] * len(found)
        for p in range(len(found) - 19):
            w = tuple(found[p : p + 20])
            if w in seen:
                keep[p : p + 20] = [False] * 20
            seen.add(w)
        kept[i, t] = [w for w, k in zip(found, keep) if k]
    return [(i, len(WORD.findall(t or "")), kept[i if i is not None else 2**63 - 1, t or ""]) for i, t, _ in rows]


@pytest.mark.parametrize("hot, heavy", [(2_000, 2_000), (1, 2_000), (2_000, 1), (3, 4)])
def test_substring_removal_matches_brute_force(spark, monkeypatch, hot, heavy):
    monkeypatch.setattr(substrings, "HOT_CONTENTS", hot)
    monkeypatch.setattr(substrings, "HEAVY_ROWS", heavy)
    docs = odd_documents(spark)
    want = sorted((str(i), n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, k in without(plain(docs)))
    got = substrings.removed(docs.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(n for _, _, n, _ in want) > 300
    left = substrings.without_repeats(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    assert sorted(str((i, len(k))) for i, n, k in without(plain(docs)) if k or not n) == sorted(str((r.doc_id, len(WORD.findall(r.text or "")))) for r in left.collect())
    assert substrings.removed(spark.createDataFrame([], DOCS)).count() == 0 and substrings.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_windows_of_a_hot_key_never_gather(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_CONTENTS", 20)
    common = " ".join(f"common{k}" for k in range(25))
    rows = [(i, " ".join([*(f"a{i}_{k}" for k in range(30)), common, *(f"b{i}_{k}" for k in range(30))])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, pieces, _ = substrings.candidates(docs)
    has_common = pieces.where(F.instr(F.col("words").cast("string"), "common10") > 0)
    assert has_common.count() <= 20
    want = {i: (85, 25 if i else 0) for i in range(120)}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substrings.removed(docs).collect()} == want


def test_fm_index_counts_patterns():
    r = np.random.default_rng(4)
    lengths = r.integers(3, 70, 25)
    text = np.concatenate([np.append(r.integers(1, 4, n), 0) for n in lengths])
    inside = np.concatenate([np.arange(n + 1) for n in lengths])
    index = fmindex.FMIndex(text, 3, inside)
    ends = np.flatnonzero(inside >= 5)  # a stream is read within its segment
    got = zip(ends, *index.matching(text, ends, 5))
    count = defaultdict(list)
    for e in np.flatnonzero(inside > 0):
        for n in range(1, min(5, inside[e]) + 1):
            count[tuple(text[e - n : e])].append(e - n)
    for e, n, a, z in got:
        n = int(n)
        assert n == max((k for k in range(1, 6) if len(count[tuple(text[e - k : e])]) > 1), default=0)
        assert not n or sorted(index.locate(np.arange(a, z))) == sorted(count[tuple(text[e - n : e])])


def test_heavy_keys_are_found_whatever_the_partitions(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN -2 ELSE id END AS key").repartition(7)
    found, total = substrings.heavy(rows, "key", counters=40)
    assert total == 20_000 and {7, -2} >= set(found) and 7 in found and found[7] <= 6667 and len(found) <= 40



def test_sharding_is_balanced_contiguous_and_gapless(spark):
    docs = odd_documents(spark).where("n_chars IS NULL OR n_chars < 9000")
    rows = sharding.shard_by_bytes(docs, 4).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r.size
    assert len(rows) == docs.count() and set(sizes) == set(range(4))
    largest = max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    by = {(str(i), t) for i, t, _ in plain(docs)}
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows if r.doc_id not in (2, None)) == sorted((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in by if i not in ("2", "None"))
    assert sharding.shard_by_bytes(spark.createDataFrame([], DOCS)).count() == 0


def test_sketch_fingerprints_match_brute_force(spark):
    docs = odd_documents(spark).where("doc_id IS NULL OR doc_id != 2")
    rows = [(i, t or "") for i, t, _ in plain(docs)]
    number = lambda t: {p: 0 for p in re.findall(r"[^\n]{1,200}", t)}
    alike = lambda a, b: len(set(number(a)) & set(number(b))) / len(set(number(a)) | set(number(b))) if number(a) or number(b) else 1.0
    got = sketches.fingerprint_versions(docs).collect()
    ordered = sorted((x for x in rows if x[0] is not None), reverse=True)
    nulls = [x for x in rows if x[0] is None]
    result = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(ordered[:-1]):
        after, half = ordered[k + 1][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = result[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - alike(t, edited)) < 1e-12 and abs(r.near_next - alike(t, after)) < 1e-12
    assert {r.n_chars for r in got if r.doc_id is None} == {len(t) for _, t in nulls}
    by_text = defaultdict(set)
    for i, t in ordered:
        by_text[t].add(result[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) >= len(by_text) - 3
    assert sketches.fingerprint_versions(spark.createDataFrame([], DOCS)).count() == 0


def test_peeling_recovers_or_reports_failure(spark):
    rows = [(0, 8, [1, 2, 3, 4], [3, 5, 6, 7] + []), (1, 8, list(range(100)), list(range(100, 200))), (2, 700, list(range(400)), []), (3, 8, [1, 2], [1, 2])]
    df = spark.createDataFrame(rows, "row long, third int, a array<long>, b array<long>").withColumn("which", F.lit(0)).repartition("row")
    got = {r.row: r for r in sketches.decode(df, sketches.ROUNDS).collect()}
    assert got[0].ok and (got[0].only_a, got[0].only_b) == (3, 3) and not got[1].ok and got[2].ok and got[2].only_a == 400 and 3 not in got
    pairs = df.select("row", F.array(F.struct("which", "a", "b"), F.struct(F.lit(1).alias("which"), F.col("b").alias("a"), F.col("a").alias("b"))).alias("pairs"))
    found = {(r.row, r.which): (r.only_a, r.only_b) for r in sketches.differences(pairs).collect()}
    assert found == {(0, 0): (3, 3), (0, 1): (3, 3), (1, 0): (100, 100), (1, 1): (100, 100), (2, 0): (400, 0), (2, 1): (0, 400)}


def test_neighbours_of_repeated_and_null_ids(spark):
    docs = odd_documents(spark).unionByName(odd_documents(spark).where("doc_id IS NULL OR doc_id % 9 = 4"))
    alike = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    parts = lambda t: set(re.findall(r"[^\n]{1,200}", t))
    tied = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).collect()
    order = sorted(tied, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.tie))
    want = []
    for k, r in enumerate(order):
        t, after = r.text, order[(k + 1) % len(order)].text
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((str(r.doc_id), len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(parts(t), parts(edited)), 9), round(alike(parts(t), parts(after)), 9)))
    for n in (1, 7):
        got = sketches.fingerprint_versions(docs.repartition(n)).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
