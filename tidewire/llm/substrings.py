"""Removing passages that occurred before, by an FM-index per shard."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import drop_staged, python_batches, release, stage, whole_groups
from tidewire.llm.fmindex import FMIndex

#: Words in a window, and in the grams whose smallest hash names the shard of a window.
WINDOW, GRAM = 20, 6
#: Windows in a segment at most, so that its first and last window hold all its words.
SEGMENT = 16
#: Words hashed at a time, each distinct one once.
CHUNK = 100_000
#: Words that an index should hold; different segments of a key from which on its windows are looked up one by one; segments of a key
#: from which on it is dealt by content as well. They change the layout of the work, not its result.
SHARD_WORDS, HOT_CONTENTS, HEAVY_ROWS = 200_000, 2_000, 2_000

_NO_ID = (1 << 63) - 1
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    own = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    return np.fromiter(map(own.__getitem__, words), dtype=np.uint64, count=len(words))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1 + (b ^ (b >> np.uint64(29))) * _K2
    return x ^ (x >> np.uint64(32))


def _grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM words and of the WINDOW words from each word on, as far as there are so many."""
    two = _joined(h[:-1], h[1:])
    four = _joined(two[:-2], two[2:])
    six = _joined(four[:-2], two[4:])
    eight = _joined(four[:-4], four[4:])
    sixteen = _joined(eight[:-8], eight[8:])
    return six * _K3, _joined(sixteen[:-4], four[16:])


def _smallest(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n neighbours."""
    have = 1
    while have * 2 <= n:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def segments(lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, shard key, content key, inner) of the segments of documents laid end to end.

    A segment is a run of neighbouring windows with one shard key, the smallest hash among their grams: equal windows have equal
    keys wherever they stand. Equal content keys mean equal words. inner: a window occurs twice within the segment.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(hashes) < WINDOW:
        return none, none, none, none, none, none.astype(bool)
    gram, window = _grams(hashes)
    key = _smallest(gram, WINDOW - GRAM + 1)[: len(window)]
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(window)]
    at = np.arange(len(window))
    valid = at + WINDOW <= ends[doc]
    at, doc, key = at[valid], doc[valid], key[valid]
    if not len(at):
        return none, none, none, none, none, none.astype(bool)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    first = np.flatnonzero(place % SEGMENT == 0)
    n = np.diff(np.append(first, len(at)))
    content = _joined(_joined(window[at[first]], window[at[first + n - 1]]), n.astype(np.uint64))
    start = at[first] - (ends - lengths)[doc[first]]
    owner, own = np.repeat(np.arange(len(first)), n), window[at]
    inner = np.zeros(len(first), dtype=bool)
    for period in range(1, SEGMENT):
        twice = np.flatnonzero(own[:-period] == own[period:])
        inner[owner[twice[owner[twice] == owner[twice + period]]]] = True
    return doc[first], start, n, key[first].view(np.int64), content.view(np.int64), inner


def _packed(start: np.ndarray, n: np.ndarray, inner: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, n (up to SEGMENT) and two flags in one long, ordered like start."""
    return (start << 8) | (n << 2) | (inner.astype(np.int64) << 1) | many


def _find(batches):
    """id, tie, at, key, content, again: a row a segment; at as in _packed.

    Of the segments of a batch with the same words the first stays, marked `many`; the others are again: an earlier one has their words.
    """
    for batch in batches:
        ids = np.array([_NO_ID if i is None else i for i in batch.column(0).to_pylist()], dtype=np.int64)
        texts = batch.column(1)
        ties, parts, at = np.zeros(len(ids), dtype=np.int64), [], 0
        while at < len(ids):
            lengths, words, begin = [], [], at
            while at < len(ids) and (at == begin or len(words) < CHUNK):
                text = (texts[at].as_py() or "").encode("utf-8", "surrogatepass")
                own = text.split()
                ties[at] = zlib.crc32(text)
                words += own
                lengths.append(len(own))
                at += 1
            doc, *rest = segments(np.array(lengths), _hashes(words))
            parts.append((doc + begin, *rest))
        if not parts:
            continue
        doc, start, n, key, content, inner = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, ties[doc], ids[doc], content, key))
        doc, start, n, key, content, inner = (x[order] for x in (doc, start, n, key, content, inner))
        # Rows that repeat an id and its text tie with the first: they are one document, and one of them is enough.
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        heads = np.flatnonzero(new)
        head = heads[np.cumsum(new) - 1]
        again = (ids[doc] != ids[doc[head]]) | (ties[doc] != ties[doc[head]]) | (start != start[head])
        many = np.zeros(len(doc), dtype=bool)
        many[head[again]] = True
        stay = new | again
        columns = (ids[doc], ties[doc], _packed(start, n, inner, many), key, content)
        yield pa.RecordBatch.from_arrays([*(pa.array(c[stay], pa.int64()) for c in columns), pa.array(again[stay])], names=["id", "tie", "at", "key", "content", "again"])


def heavy(rows: DataFrame, column: str, counters: int = 2000) -> tuple[dict[int, int], int]:
    """(values, rows): every value of a long column that over one in `counters` / 2 of all rows hold, with a lower bound of its count.

    Each task keeps `counters` counts over its rows; what it takes off when it has more is at most a share 1 / counters of them.
    At most `counters` values come to the driver, as their counts add up to no more than all rows.
    """

    def run(batches):
        counts: dict[int, int] = {}
        total = 0
        for batch in batches:
            values, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            total += int(n.sum())
            for v, c in zip(values.tolist(), n.tolist()):
                counts[v] = counts.get(v, 0) + c
            if len(counts) > 64 * counters:
                least = np.partition(np.fromiter(counts.values(), np.int64), -counters)[-counters]
                counts = {v: c - least for v, c in counts.items() if c > least}
        kept = sorted(counts.items(), key=lambda x: -x[1])
        least = kept[counters][1] if len(kept) > counters else 0
        kept = [(v, c - least) for v, c in kept[:counters] if c > least]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in kept] + [None], pa.int64()), pa.array([c for _, c in kept] + [total], pa.int64())], names=["value", "n"])

    sums = rows.select(column).mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    total = sums.where("value IS NULL").agg(F.max("n")).first()[0] or 0
    found = sums.where((F.col("value").isNotNull()) & (F.col("n") * counters >= total))
    return {r.value: r.n for r in found.collect()}, total


#: What becomes of a segment: its words were there before; it goes to an index; its windows are looked up one by one.
AGAIN, INDEXED, SINGLE = 0, 1, 2


def _sorted_out(single_keys: frozenset, most: int):
    """Over partitions of (key, salt, content, id, tie, at) in that order: id, tie, start, n, key, kind of the segments that may hold a repeated window.

    The first of each content stands for all with it, the others are AGAIN. A key that one content alone has, without a window that
    occurs twice in it, has nothing more to find. The contents of a key are held back until it ends, or there are over `most` of
    them, from where on they are SINGLE: memory is bounded by `most` rows and a batch.
    """

    def rows(firsts: np.ndarray, kind) -> tuple:
        key, _, id_, tie, at = firsts
        return id_, tie, at >> 8, (at >> 2) & 63, key, np.broadcast_to(np.int32(kind), id_.shape)

    def judged(firsts: np.ndarray) -> tuple:
        """Rows of whole keys."""
        group = _runs(firsts[0], firsts[1])
        n = np.bincount(group)
        inner = np.bincount(group, weights=(firsts[4] >> 1) & 1) > 0
        begin = np.append(0, np.cumsum(n)[:-1])
        single = (n > most) | np.fromiter((k in single_keys for k in firsts[0][begin].tolist()), bool, len(n))
        kept = (single | (n > 1) | inner)[group]
        return rows(firsts[:, kept], np.where(single, SINGLE, INDEXED).astype(np.int32)[group[kept]])

    def run(batches):
        last, open_, over = None, np.zeros((5, 0), dtype=np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, content, id_, tie, at = (batch.column(c).to_numpy() for c in ("key", "salt", "content", "id", "tie", "at"))
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (content[1:] != content[:-1])
            place = np.column_stack([id_, tie, at >> 8])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            if last is not None and last[0] == (key[0], salt[0], content[0]):
                new[0] = False
                first = np.where(first == 0, -1, first)
                place = np.vstack([place, last[1]])  # the first of the content that the batch before ended in is at -1
            again = ~new & (place[: len(key)] != place[first]).any(axis=1)
            last = (key[-1], salt[-1], content[-1]), place[first[-1]]
            firsts = np.stack([key, salt, id_, tie, at])
            out = [rows(firsts[:, again], AGAIN)]
            firsts = firsts[:, new]
            if over is not None:  # more of a key that has too many already
                more = (firsts[0] == over[0]) & (firsts[1] == over[1])
                out.append(rows(firsts[:, more], SINGLE))
                firsts = firsts[:, ~more]
                over = over if not firsts.shape[1] else None
            open_ = np.concatenate([open_, firsts], axis=1)
            if open_.shape[1]:
                same = (open_[0] == open_[0, -1]) & (open_[1] == open_[1, -1])
                if not same.all():
                    out.append(judged(open_[:, ~same]))
                    open_ = open_[:, same]
                if open_.shape[1] > most:
                    out.append(rows(open_, SINGLE))
                    open_, over = open_[:, :0], (open_[0, 0], open_[1, 0])
            yield _rows(out)
        if open_.shape[1]:
            yield _rows([judged(open_)])

    return run


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Numbers the runs of equal keys."""
    new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.append(0, np.cumsum(new))


def _rows(parts) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "tie", "start", "n", "key", "kind"])


def _cut(batches):
    """From documents with their segments (start, n, key, single), sorted by document: a row a segment, with its words.

    A single segment comes as its windows, each with a key of its own words in place of them. Rows that repeat id and text are cut once a task.
    """
    last = None
    for batch in batches:
        rows = []
        for id_, tie, text, found in zip(*(batch.column(c).to_pylist() for c in ("id", "tie", "text", "found"))):
            if (id_, tie) == last:
                continue
            last = id_, tie
            words = _words(text)
            for s in found:
                start, n = s["start"], s["n"]
                if s["single"]:
                    windows = [(k, b" ".join(words[k : k + WINDOW])) for k in range(start, start + n)]
                    rows += [(id_, tie, k, xxhash.xxh64_intdigest(w) - (1 << 63), None) for k, w in windows]
                else:
                    rows.append((id_, tie, start, s["key"], b" ".join(words[start : start + n + WINDOW - 1])))
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "tie", "start", "key", "words"])


def _search(pdf):
    """For whole shards of segments: runs of windows (id, tie, start, n) that occur in the shard at an earlier place too.

    The segments are indexed and then streamed against the index; of each end with a matching statistic of WINDOW words
    the first of its places is looked up.
    """
    import pandas as pd

    out = []
    for _, part in pdf.groupby("shard", sort=False):
        split = [bytes(w).split() for w in part["words"]]
        ids: dict[bytes, int] = {}
        lengths = np.array([len(w) + 1 for w in split])
        text = np.array([x for w in split for x in (*(ids.setdefault(y, len(ids) + 1) for y in w), 0)], dtype=np.int64)
        segment = np.repeat(np.arange(len(split)), lengths)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ends = np.flatnonzero(inside >= WINDOW)  # the place after a window: a word or the separator
        index = FMIndex(text, len(ids), inside)
        length, lo, hi = index.matching(text, ends, WINDOW)
        found = length == WINDOW
        if not found.any():
            continue
        begin, lo, hi = ends[found] - WINDOW, lo[found], hi[found]
        id_, tie, start = (part[c].to_numpy() for c in ("id", "tie", "start"))
        place = np.lexsort((start[segment] + inside, tie[segment], id_[segment]))
        rank = np.empty(len(text), dtype=np.int64)
        rank[place] = np.arange(len(text))
        spans, back = np.unique(lo, return_inverse=True)
        widths = np.zeros(len(spans), dtype=np.int64)
        widths[back] = hi - lo
        edges = np.append(0, np.cumsum(widths))
        rows = np.repeat(spans - edges[:-1], widths) + np.arange(edges[-1])
        first = np.minimum.reduceat(rank[index.locate(rows)], edges[:-1])
        late = np.sort(begin[rank[begin] > first[back]])
        # Places of a row and of its repetition tie: both are of one document, which keeps its first occurrence.
        if not len(late):
            continue
        new = np.append(True, (np.diff(late) != 1) | (segment[late[1:]] != segment[late[:-1]]))
        head = late[new]
        n = np.diff(np.append(np.flatnonzero(new), len(late)))
        s = segment[head]
        out.append(pd.DataFrame({"id": id_[s], "tie": tie[s], "start": start[s] + inside[head], "n": n}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "tie", "start", "n")})


def _drop(words: list[bytes], runs) -> list[bytes]:
    keep = np.ones(len(words) + 1, dtype=np.int64)
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for r in runs:
        edge[r["start"]] += 1
        edge[min(len(words), r["start"] + r["n"] + WINDOW - 1)] -= 1
    keep = np.cumsum(edge)[:-1] == 0
    return [w for w, k in zip(words, keep) if k]


def late_windows(windows: DataFrame, salts: int = 16) -> DataFrame:
    """id, tie, start, n: the windows (id, tie, start, key) whose key stands at an earlier place too, each as a run of one.

    Equal windows are reduced by min() before the shuffle, and only joined after it: each key's first place stands under `salts`
    salts, over which its windows are dealt.
    """
    place = F.struct("id", "tie", "start")
    first = windows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last")).select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return windows.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(salts)).cast("int")).join(first, ["key", "salt"]).where(place != F.col("first")).select("id", "tie", "start", F.lit(1).cast("long").alias("n"))


def candidates(docs: DataFrame, heavy_rows: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """runs (id, tie, start, n) known to occur earlier, the segments (id, tie, start, key, words) left to search, and over how many shards.

    id is doc_id (the largest long for null, which so comes last), tie the CRC-32 of the text: rows that share an id go by
    it, and rows that share both are one document. Segments of the same words, told by 128 bits of hashes, share their
    matching statistics: the first goes on, the others occur earlier as a whole. Segments meet once, by key; those of a key that
    very many hold meet by key and content.
    """
    heavy_rows, most = HEAVY_ROWS if heavy_rows is None else heavy_rows, HOT_CONTENTS if most is None else most
    found = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, "id long, tie long, at long, key long, content long, again boolean"))
    start, n = F.shiftright("at", 8).alias("start"), F.shiftright("at", 2).bitwiseAND(63).alias("n")
    known = stage(found.where("again").select("id", "tie", start, n))
    new = found.where("NOT again")
    keys, _ = heavy(new, "key")
    hot = frozenset(k for k, c in keys.items() if c >= heavy_rows)
    salt = F.when(F.col("key").isin(list(hot)), F.pmod("content", F.lit(256)) + 1).otherwise(0).cast("long").alias("salt") if hot else F.lit(0).cast("long").alias("salt")
    dealt = new.select("key", salt, "content", "id", "tie", "at").repartition("key", "salt").sortWithinPartitions("key", "salt", "content", "id", "tie", "at")
    sorted_out = stage(dealt.mapInArrow(_sorted_out(hot, most), "id long, tie long, start long, n long, key long, kind int"))
    drop_staged(found)
    release(docs.sparkSession)

    again = known.unionByName(sorted_out.where(F.col("kind") == AGAIN).select("id", "tie", "start", "n"))
    firsts = sorted_out.where(F.col("kind") != AGAIN)
    total = firsts.agg(F.sum(F.when(F.col("kind") == INDEXED, F.col("n") + WINDOW)).alias("words"), F.max("kind").alias("kind")).first()
    shards = max(1, -(-(total.words or 0) // SHARD_WORDS))
    wanted = firsts.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n", "key", (F.col("kind") == SINGLE).alias("single"))).alias("found"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.crc32(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    cut = texts.join(wanted.hint("merge"), ["id", "tie"]).mapInArrow(_cut, "id long, tie long, start long, key long, words binary")
    if total.kind != SINGLE:
        return again, cut, shards
    # All windows equal to such a key's have that key, so they only meet each other: no index is needed to find their first places.
    cut = stage(cut)
    return again.unionByName(late_windows(cut.where("words IS NULL"))), cut.where("words IS NOT NULL"), shards


def repeated_runs(docs: DataFrame) -> DataFrame:
    """id, tie, __runs (set of start, n): the runs of windows of each document (doc_id, text) that also start earlier; id and tie as in candidates()."""
    python_batches(docs.sparkSession)
    runs, cut, shards = candidates(docs)
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).drop("key")
    late = cut.repartition("shard").sortWithinPartitions("shard").mapInPandas(whole_groups(_search, ["shard"]), "id long, tie long, start long, n long")
    # A set, so that rows that repeat an id and its text add nothing.
    return stage(runs.unionByName(late).groupBy("id", "tie").agg(F.collect_set(F.struct("start", "n")).alias("__runs")))


def _with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__tie": F.crc32(F.coalesce("text", F.lit("")))})
    return keyed.join(runs.withColumnsRenamed({"id": "__id", "tie": "__tie"}), ["__id", "__tie"], "left")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text).

    Every word covered by a window of WINDOW words that also starts earlier (at a smaller id, or earlier in the document) is removed.
    A null text has no words; a null id comes after all others; rows that share an id go by the CRC-32 of their
    texts, and rows that repeat id and text are one document, with a result each. Other columns are not used. An empty table gives an empty
    result.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("__runs").to_pylist()):
                words = _words(text)
                kept = _drop(words, runs)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_runs(docs.select("doc_id", "text"), repeated_runs(docs)).select("doc_id", "text", "__runs").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the texts that are left. A text that loses nothing stays as it is, others are joined by one space; a document that loses all goes."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("__runs").to_pylist()):
                if runs:
                    text = b" ".join(_drop(_words(text), runs)).decode("utf-8", "surrogatepass") or None
                texts.append((text, bool(runs)))
            new = pa.array([t for t, _ in texts], pa.string())
            columns = [new if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([c for _, c in texts], pa.bool_())], names=[*names, "__cut"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = _with_runs(docs, repeated_runs(docs)).select(*names, "__runs").mapInArrow(run, f"{schema}, `__cut` boolean")
    out = out.where("NOT (`__cut` AND text IS NULL)")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)
