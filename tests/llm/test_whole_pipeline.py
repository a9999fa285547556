"""The whole pipeline against a plain version: loops over rows in memory, from documents to pieces."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.data import odd_documents, words
from tidewire.llm import mixing, packing, quality, simhash

WORD = r"[^\x20\x09-\x0D]+"
INT, LONG = "<i", "<q"


def hashed(*values):
    """Spark's xxhash64 of columns: texts, or (format, number); a null leaves the hash as it is."""
    h = 42
    for v in values:
        if isinstance(v, tuple) and v[1] is not None:
            h = xxhash.xxh64_intdigest(struct.pack(*v), seed=h)
        elif isinstance(v, str):
            h = xxhash.xxh64_intdigest(v.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def good_quality(rows, good):
    def held_out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 0

    found = [(hashed((LONG, r["doc_id"])), quality.features(r["text"]).tolist(), r) for r in rows]
    take = lambda ok: np.array([x for _, x, r in sorted(found, key=lambda f: f[:2]) if ok(r["doc_id"])], dtype=np.float64)
    model, _ = quality.fit(take(lambda i: not held_out(i) and i in good), take(lambda i: not held_out(i)))
    return [r for r in rows if model.score(np.stack([quality.features(r["text"])]))[0] >= 0.3]


def one_of_copies(rows):
    prints = [simhash.both_fingerprints(r["text"], 5) for r in rows]
    sets, root = [set(p[2].tolist()) for p in prints], list(range(len(rows)))
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            near = 5 * both >= 4 * (len(sets[x]) + len(sets[y]) - both) and apart(prints[x][0], prints[y][0]) <= 14 and apart(prints[x][1], prints[y][1]) <= 14 + simhash.SLACK
            if sets[x] == sets[y] or near:
                root[top(x)] = top(y)
    best = {}
    for x, r in enumerate(rows):
        own = prints[x][2]
        content = (xxhash.xxh64_intdigest(own.tobytes()) | 1) - (1 << 63) if len(own) else 0
        key = (r["doc_id"] is None, r["doc_id"] or 0, prints[x][0], content, hashed(r["text"]))
        if top(x) not in best or key < best[top(x)][0]:
            best[top(x)] = (key, r)
    return [r for _, r in best.values()]


def without_repeats(rows):
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode())))
    seen, out = set(), []
    for r in order:
        ws = re.findall(WORD, r["text"] or "")
        gone = set()
        for s in range(len(ws) - 19):
            window = tuple(ws[s : s + 20])
            if window in seen:
                gone.update(range(s, s + 20))
            seen.add(window)
        if gone:
            kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
            r = {**r, "text": kept, "n_chars": len(kept)} if kept else None
        if r:
            out.append(r)
    return out


def permuted(k, n, *salt):
    high = math.ceil(math.sqrt(n))
    wide = math.ceil(n / high)

    def once(x):
        row, column = x // wide, x % wide
        for r in range(mixing.ROUNDS):
            if r % 2 == 0:
                row = (row + hashed((INT, r), (LONG, column), *salt) % high) % high
            else:
                column = (column + hashed((INT, r), (LONG, row), *salt) % wide) % wide
        return row * wide + column

    x = once(k)
    while x >= n:
        x = once(x)
    return x


def mixed(rows, cycle=(3, 1, 2), share=1.5, most=2, block_words=128, shard_slots=1 << 14, seed=7, salts=64):
    sized = [(r, len(re.findall(WORD, r["text"] or "")), hashed(r["text"])) for r in rows]
    sizes = Counter()
    for r, n, _ in sized:
        sizes[r["source"]] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), list(names)
    while open_:  # sources that fill up stop, the others share what is left
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if most * sizes[s] <= weight[s] * level]
        for s in full or open_:
            target[s] = most * sizes[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    blocks = [math.ceil(sizes[s] / block_words) for s in names]
    quota = [min(most * b, math.floor(target[s] * b / sizes[s] + 0.5)) if b else 0 for s, b in zip(names, blocks)]
    total, blocks = sum(quota), [max(b, 1) for b in blocks]

    def holder(p, widths):
        for k, w in enumerate(widths):
            if p < w:
                return k
            p -= w

    drawn = defaultdict(Counter)
    for slot in range(total):
        drawn[slot // shard_slots][holder(hashed((INT, seed), (LONG, slot)) % total, quota)] += 1
    prior, over, final = Counter(), {}, defaultdict(Counter)
    for shard in sorted(drawn):
        for k, n in drawn[shard].items():
            final[shard][k] = max(0, min(n, quota[k] - prior[k]))
        over[shard] = sum(n - final[shard][k] for k, n in drawn[shard].items())
        prior.update(drawn[shard])
    lack = [q - sum(f[k] for f in final.values()) for k, q in enumerate(quota)]
    p = 0
    for shard in sorted(over):
        for _ in range(over[shard]):
            final[shard][holder(p, lack)] += 1
            p += 1
    times, first = Counter(), Counter()
    for shard in sorted(final):
        for k, n in final[shard].items():
            for slot in range(first[k], first[k] + n):
                times[k, permuted(slot % blocks[k], blocks[k], (INT, seed), (INT, k), (LONG, slot // blocks[k]))] += 1
            first[k] += n

    out, at = [], Counter()
    null_first = lambda i: (i is not None, i or 0)
    for r, n, tie in sorted(sized, key=lambda x: (hashed((LONG, x[0]["doc_id"]), (LONG, x[1]), (LONG, x[2])) % salts, null_first(x[0]["doc_id"]), x[1], x[2])):
        k = names.index(r["source"])
        start = at[k]
        at[k] += n
        if not n:
            continue
        taken = [times[k, (start + i) // block_words] for i in range(n)]
        ws = re.findall(WORD, r["text"])
        for turn in range(1, max(taken) + 1):
            text = r["text"] if min(taken) >= turn else " ".join(w for w, t in zip(ws, taken) if t >= turn)
            out.append({**r, "text": text, "n_chars": len(text)})
    return out


def pieces(rows, capacity=4096):
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in rows:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            cut = ids[k : k + capacity]
            out.append((r["doc_id"], k // capacity, k, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))))
    return out


def test_the_pipeline_is_the_plain_version(spark, tmp_path):
    r = random.Random(12)
    docs = odd_documents(spark).drop("runs", "fp", "size")
    base = words(r, 120).split()
    more = [(500 + k, " ".join([*base[: 10 + k], f"y{k}", *base[11 + k :]]), "en", "hot", None) for k in range(6)]
    more += [(600 + k, words(r, 700), "de", "s2" if k % 2 else "hot", 5) for k in range(8)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    good = {*range(0, 40, 2), 500, 501, 600, 601, 602}
    spark.createDataFrame([(k, int(k in good), 0) for k in [*range(44), 500, 501, *range(600, 608)]] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [x.asDict() for x in docs.collect()]
    whole = lambda xs: sorted((tuple(x.values()) for x in xs), key=str)

    plain = [lambda x: good_quality(x, good), one_of_copies, without_repeats, mixed]
    counts = [len(rows)]
    for k, (step, (_, stage)) in enumerate(zip(plain, corpus_pipeline.STAGES)):
        rows = step(rows)
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = whole(x.asDict() for x in docs.collect())
        assert got == whole(rows), (k, [x for x in got if x not in whole(rows)][:3], [x for x in whole(rows) if x not in got][:3], len(got), len(rows))
        counts.append(len(rows))
    assert counts[2] < counts[1] and counts[4] > counts[3] > 0

    expected = pieces(rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(expected, key=str)
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(bins) == packing.best_plan(Counter(x[3] for x in expected), 4096).bins


def test_words_taken_are_those_of_the_plain_mix(spark):
    """Also over several output shards, where draws beyond a quota are moved."""
    r = random.Random(4)
    rows = [dict(doc_id=k, text=words(r, r.choice([0, 1, 40, 300])), lang=None, source=r.choice(["a", "b", "hot", "hot", "hot", None]), n_chars=0) for k in range(60)]
    docs = spark.createDataFrame([tuple(x.values()) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for shard_slots in (1 << 14, 16):
        taken = Counter()
        for x in mixed(rows, block_words=32, shard_slots=shard_slots):
            taken[x["doc_id"]] += len(x["text"].split())
        got = {x.doc_id: x.taken for x in mixing.taken_words(docs, block_words=32, shard_slots=shard_slots).collect()}
        assert got == {x["doc_id"]: taken[x["doc_id"]] for x in rows} and sum(got.values()) > 0
