import random

import corpus_pipeline
from tidewire.llm import catalog, components, simhash
from tests.llm.data import odd_documents, words


def test_stages_run_on_odd_documents(spark, tmp_path):
    labels = [(k, 1, 0) for k in range(0, 40, 2)] + [(None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd_documents(spark).drop("runs", "fp", "size").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() > 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, str(tmp_path)).count() == 0


def test_thirteen_operators_are_registered():
    names = list(catalog.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


def test_near_copies_by_five_words_leave_one(spark):
    r = random.Random(8)
    rows, k = [], 0
    for _ in range(25):
        base = words(r, 200).split()
        rows.append((k, " ".join(base)))
        for edits in (1, 2, 4, 8, 12):  # 5 shingles each: similar up to 4 edits
            copy = list(base)
            for e in range(edits):
                copy[10 + 15 * e] = "edited"
            rows.append((k + edits, " ".join(copy)))
        k += 20
    hot = words(r, 120).split()  # a large group of near copies
    for m in range(150):
        rows.append((k + m, " ".join([*hot[: 3 + m % 100], f"x{m}", *hot[4 + m % 100 :]])))
    rows += [(None, rows[0][1]), (9_000, ""), (9_001, None), (9_002, "few words"), (9_003, "Few  words")]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    prints, all_pairs, found_pairs = [simhash.both_fingerprints(t, 5)[:2] for _, t in rows], 0, 0
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            alike = 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])
            all_pairs += alike
            if alike and (sets[x] == sets[y] or apart(prints[x][0], prints[y][0]) <= 14 and apart(prints[x][1], prints[y][1]) <= 14 + simhash.SLACK):
                found_pairs += 1
                root[top(x)] = top(y)
    assert found_pairs >= 0.95 * all_pairs  # what the distance reaches
    want = {}
    for x, (i, _) in enumerate(rows):
        want.setdefault(top(x), []).append(10**9 if i is None else i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(row.doc_id for row in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted(map(min, want.values()))


def test_tiles_verify_every_pair(spark, monkeypatch):
    r = random.Random(9)
    base = [words(r, 150).split() for _ in range(6)]
    rows = [(k, " ".join([*(b := base[k % 6])[: 5 + k], f"y{k}", *b[6 + k :]])) for k in range(60)]
    rows += [(100 + k, " ".join(words(r, 20).split() + base[0][: 100 + 5 * k])) for k in range(8)]  # some similar, some not
    found = [(k + 1, *simhash.both_fingerprints(t, 5), t) for k, t in rows]
    marked = spark.createDataFrame([(k, fp, more, len(own), -k, t) for k, fp, more, own, t in found], "content long, fp long, more long, size int, tie long, text string")
    texts = marked.select("tie", "text")
    want, root = [], {k: k for k, *_ in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, fp, more, own, _ in found:
        for j, fq, most, other, _ in found:
            both = len(set(own.tolist()) & set(other.tolist()))
            if i < j and ((fp ^ fq) & (2**64 - 1)).bit_count() <= 14 and ((more ^ most) & (2**64 - 1)).bit_count() <= 14 + simhash.SLACK and 5 * both >= 4 * (len(own) + len(other) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {(k, top(k)) for k in root if any(top(o) == top(k) for o in root if o != k)}
    links = []
    for tile, whole in ((4, 0), (1024, 32), (1024, 8192)):
        monkeypatch.setattr(simhash, "WHOLE_TREE", whole)
        links.append({(x.node, x.component) for x in components.connected_components(simhash.similar_links(marked.drop("text"), texts, 5, 14, (4, 5), 5, tile_rows=tile)).collect()})
    assert links[0] == links[1] == links[2] == want and len({c for _, c in want}) >= 6
