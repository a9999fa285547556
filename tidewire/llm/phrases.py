"""Phrase collocations by stripes: each first word keys counters of the words that follow it, merged elementwise."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import python_batches, stage

#: Bytes of text that a worker counts at a time.
FLUSH = 1 << 22
#: Words of at least 1 in HEAVY occurrences have stripes of several blocks, about one for each such share: there can't be more of them.
HEAVY, LONGEST_HEAVY = 1 << 13, 256
#: Entries that a stripe holds in a worker at most before they are passed on as they are.
ENTRIES = 1 << 21
#: Entries that a worker merges at a time, at least.
CHUNK = 1 << 20
#: Tasks into which the ranking of one language is dealt first.
SALTS = 64


def _folding() -> bytes:
    """A-Z to lower case, what ends a piece to a line feed, tabs to spaces."""
    table = bytearray(range(256))
    for c in range(65, 91):
        table[c] = c + 32
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        table[c] = 10
    table[9] = 32
    return bytes(table)


FOLDED = _folding()


def _flushes(batches):
    """(lang, folded bytes of whole pieces), about FLUSH bytes at a time; texts are parted by a line feed, and longer ones cut only at one.

    A language's texts are held over batches; of very many languages, all are handed over once they hold 4 x FLUSH bytes together.
    """
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for k in range(batch.num_rows):
            lang, raw = batch.column(0)[k].as_py(), (batch.column(1)[k].as_py() or "").encode().translate(FOLDED)
            at = 0
            while at < len(raw):
                end = len(raw) if len(raw) - at <= FLUSH else raw.find(b"\n", at + FLUSH)
                end = len(raw) if end < 0 else end
                held.setdefault(lang, []).append(raw[at:end])
                sizes[lang] += end - at
                at = end
                if sizes[lang] >= FLUSH:
                    yield lang, b"\n".join(held.pop(lang))
                    sizes.pop(lang)
        if sizes.total() >= 4 * FLUSH:
            for lang in list(held):
                yield lang, b"\n".join(held.pop(lang))
            sizes.clear()
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def _coded(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """The numbers of a text's words, a 0 at the end of each piece, and the words by number: 0 is the end of a piece, 1 the empty string."""
    tokens = pc.split_pattern(pa.array([b"\n  " + text.replace(b"\n", b" \n ")], pa.large_binary()), b" ").flatten().dictionary_encode()
    found = tokens.indices.to_numpy().astype(np.int64)
    return found[found != 1][1:], tokens.dictionary.cast(pa.binary())


def _word_counts(batches):
    for _, text in _flushes(batches):
        found, words = _coded(text)
        times = np.bincount(found, minlength=len(words))[2:]
        yield pa.RecordBatch.from_arrays([words[2:], pa.array(times)], names=["word", "n"])


def _joined(words: pa.Array, two: np.ndarray, three: np.ndarray, own: np.ndarray, stripes: int) -> pa.Array:
    """For each of the stripes, its entries (own: of which stripe, in order) as lines of two words; the end of a piece is an empty word."""
    keys = pc.binary_join_element_wise(words.take(pa.array(two)), words.take(pa.array(three)), pa.scalar(b" ", pa.binary()))
    ends = np.searchsorted(own, np.arange(stripes + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), keys), pa.scalar(b"\n", pa.binary()))


def _triples(one: np.ndarray, two: np.ndarray, three: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct triples of numbers below n, in order, and how often each comes."""
    pairs, pair = None, one * n + two
    if n > 1 << 21:  # three numbers fill more than 63 bits
        pairs, pair = np.unique(pair, return_inverse=True)
    keys = np.sort(pair * n + three)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    times = np.diff(np.r_[starts, len(keys)])
    pair, three = np.divmod(keys[starts], n)
    one, two = np.divmod(pair if pairs is None else pairs[pair], n)
    return one, two, three, times


def _stripes(blocks: dict[bytes, int]):
    """For mapInArrow over (lang, text): lang, w1, block, once, more, times. A stripe has the two words after w1 of every occurrence."""

    def run(batches):
        for lang, text in _flushes(batches):
            c, found = _coded(text)
            words = found.to_pylist()
            c = np.r_[c, 0, 0]
            one, two, three = c[:-2], c[1:-1], np.where(c[1:-1] == 0, 0, c[2:])
            at, n = one > 0, len(words)
            one, two, three, times = _triples(one[at], two[at], three[at], n)

            split = np.fromiter((blocks.get(w, 1) for w in words), np.int64, n)
            sums = np.fromiter(map(zlib.crc32, words), np.int64, n)
            sums[0] = 0
            # The block follows the second word; of two heavy words, whose pair may be as frequent as a word, also the third.
            block = np.where(split[one] > 1, (sums[two] + np.where(split[two] > 1, 31 * sums[three], 0)) % split[one], 0)
            key = one * (int(split.max()) + 1) + block
            order = np.argsort(key, kind="stable")
            key, one, two, three, block, times = key[order], one[order], two[order], three[order], block[order], times[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            own = np.cumsum(np.isin(np.arange(len(key)), starts, assume_unique=True)) - 1
            once, stripes = times == 1, len(starts)
            names = pa.array([b"", b"", *words[2:]], pa.binary())
            more_ends = np.searchsorted(own[~once], np.arange(stripes + 1))
            counts = times[~once].astype(np.uint32)
            columns = [
                pa.array([lang] * stripes, pa.string()),
                names.take(pa.array(one[starts])),
                pa.array(block[starts].astype(np.int32)),
                _joined(names, two[once], three[once], own[once], stripes),
                _joined(names, two[~once], three[~once], own[~once], stripes),
                pa.array([counts[a:b].tobytes() for a, b in zip(more_ends, more_ends[1:])], pa.binary()),
            ]
            whole = pa.RecordBatch.from_arrays(columns, names=["lang", "w1", "block", "once", "more", "times"])
            yield from (whole.slice(k, 1 << 15) for k in range(0, stripes, 1 << 15))

    return run


def _entries(batch: pa.RecordBatch, own: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The entries of a batch of stripes: of which stripe (own: of each row), their two words, how often."""
    found = []
    for name in ("once", "more"):
        at = pc.greater(pc.binary_length(batch.column(name)), 0)
        lists = pc.split_pattern(batch.column(name).filter(at), b"\n")
        entries = lists.flatten()
        times = np.ones(len(entries), np.int64) if name == "once" else np.frombuffer(b"".join(batch.column("times").to_pylist()), np.uint32).astype(np.int64)
        found.append((own[at.to_numpy(zero_copy_only=False)][pc.list_parent_indices(lists).to_numpy()], entries, times))
    own, entries, times = zip(*found)
    return np.concatenate(own), pa.concat_arrays(entries), np.concatenate(times)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of times of each."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[starts], np.add.reduceat(times[order], starts) if len(starts) else times[:0]


def _merged(blocks: dict[bytes, int], least: int):
    """For mapInArrow over stripes in order of lang, w1, block: lang, w1, w2, w3, n, the merged stripes' entries of at least `least`.

    What is rarer is summed: triples into a row of their pair (w3 null), pairs into one of their first word (w2 null too), where also the
    ends of pieces count. A pair of heavy words lies in several blocks and isn't summed away; a stripe of more than ENTRIES entries
    passes them all on. Many stripes are merged at a time, as columns of at least CHUNK entries.
    """

    def run(batches):
        names: list[tuple[str, bytes]] = []  # lang and first word of the stripes held, by number; the last one is open
        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        last, passed, size, limit = None, False, 0, CHUNK

        def rows(own, w2, w3, times):
            lang, w1 = (pa.array([names[k][i] for k in own.tolist()], kind) for i, kind in enumerate((pa.string(), pa.binary())))
            return pa.RecordBatch.from_arrays([lang, *(w.cast(pa.string()) for w in (w1, w2, w3)), pa.array(times, pa.int64())], names=["lang", "w1", "w2", "w3", "n"])

        def merged(own, entries, times):
            codes = entries.dictionary_encode()
            n = max(len(codes.dictionary), 1)
            keys, times = _summed(own * n + codes.indices.to_numpy(), times)
            own, code = np.divmod(keys, n)
            return own, codes.dictionary, code, times

        def hand_over(own, entries, times, everything: np.ndarray):
            """The rows of stripes; everything: whether a stripe passes on all its entries."""
            if not len(own):
                return
            partial = np.fromiter((blocks.get(w, 1) > 1 for _, w in names), bool, len(names))
            total = np.bincount(own, times, len(names)).astype(np.int64)
            large = everything | partial | (total >= least)
            null = lambda k: pa.nulls(k, pa.binary())
            if len(few := np.flatnonzero(~large & (total > 0))):
                yield rows(few, null(len(few)), null(len(few)), total[few])
            at = large[own]
            if not at.any():
                return
            own, entries, code, times = merged(own[at], entries.filter(pa.array(at)), times[at])
            parts = pc.split_pattern(entries, b" ").flatten()
            second, third = parts.take(pa.array(np.arange(0, len(parts), 2))).dictionary_encode(), parts.take(pa.array(np.arange(1, len(parts), 2)))
            words, n = second.dictionary, len(second.dictionary)
            ends, hot = pc.equal(words, b"").to_numpy(zero_copy_only=False), np.fromiter((blocks.get(w, 1) > 1 for w in words.to_pylist()), bool, n)
            pair = own * n + second.indices.to_numpy()[code]
            pairs, sums = _summed(pair, times)
            pair, (first, w2) = np.searchsorted(pairs, pair), np.divmod(pairs, n)
            stay = ~ends[w2] & ((sums >= least) | everything[first] | (partial[first] & hot[w2]))
            kept = np.flatnonzero(((times >= least) | everything[own]) & stay[pair])
            kept = kept[pc.greater(pc.binary_length(third.take(pa.array(code[kept]))), 0).to_numpy(zero_copy_only=False)]
            yield rows(own[kept], words.take(pa.array(w2[pair[kept]])), third.take(pa.array(code[kept])), times[kept])
            sums -= np.bincount(pair[kept], times[kept], len(pairs)).astype(np.int64)
            left = np.flatnonzero(stay & (sums > 0))
            yield rows(first[left], words.take(pa.array(w2[left])), null(len(left)), sums[left])
            rest = np.bincount(first[~stay], sums[~stay], len(names)).astype(np.int64)
            left = np.flatnonzero(rest)
            yield rows(left, null(len(left)), null(len(left)), rest[left])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k) for k in ("lang", "w1", "block")]
            new = np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in keys], axis=0) if batch.num_rows > 1 else np.zeros(0, bool)
            start = np.r_[tuple(c[0].as_py() for c in keys) != last, new]
            last = tuple(c[-1].as_py() for c in keys)
            if start.any() and passed:  # what was held is the end of a stripe that passes on everything
                own = np.cumsum(start) > 0
                cut = int(np.argmax(own)) if own.any() else batch.num_rows
                held.append(_entries(batch.slice(0, cut), np.full(cut, len(names) - 1)))
                yield from hand_over(*map(_together, zip(*held)), np.ones(len(names), bool))
                names, held, passed, size, limit = [], [], False, 0, CHUNK
                batch, start = batch.slice(cut), start[cut:]
                keys = [c[cut:] for c in keys]
            own = len(names) - 1 + np.cumsum(start)
            at = pa.array(np.flatnonzero(start))
            names += zip(keys[0].take(at).to_pylist(), keys[1].take(at).to_pylist())
            held.append(_entries(batch, own))
            size += len(held[-1][0])
            if size < limit:
                continue
            own, entries, times = map(_together, zip(*held))
            open_ = own == len(names) - 1
            if not passed:
                whole = ~open_
                yield from hand_over(own[whole], entries.filter(pa.array(whole)), times[whole], np.zeros(len(names), bool))
            names = names[-1:]
            own, entries, code, times = merged(np.zeros(int(open_.sum()), np.int64), entries.filter(pa.array(open_)), times[open_])
            entries = entries.take(pa.array(code))
            held, size = [(own, entries, times)], len(own)
            if size > ENTRIES:
                passed = True
                yield from hand_over(own, entries, times, np.ones(1, bool))
                held, size = [], 0
            limit = max(CHUNK, 2 * size)
        if held:
            yield from hand_over(*map(_together, zip(*held)), np.full(len(names), passed))

    return run


def _together(parts):
    return np.concatenate(parts) if isinstance(parts[0], np.ndarray) else pa.concat_arrays(parts)


def stripes(docs: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, w3, n: the merged stripes of docs (lang, text), from which all else is read.

    A row with w3 counts a phrase of three words found at least `least` times (rarer ones may be there too); without w3, further
    occurrences of the pair, without w2, of the word. So the occurrences of any prefix are the sum of its rows. Workers count
    stripes of about FLUSH bytes; a stripe goes to one task by its first word, or, if that is heavy, by block, and is merged there.
    """
    python_batches(docs.sparkSession)
    total = docs.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = stage(total)
    n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = words.where((F.col("n") * HEAVY >= n_words) & (F.octet_length("word") <= LONGEST_HEAVY)).collect()  # at most HEAVY
    blocks = {bytes(r.word): k for r in heavy if (k := -(-r.n * HEAVY // n_words)) > 1}
    held = docs.mapInArrow(_stripes(blocks), "lang string, w1 binary, block int, once binary, more binary, times binary")
    keys = ["lang", "w1", "block"]
    merged = held.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged(blocks, least), "lang string, w1 string, w2 string, w3 string, n long")
    return stage(merged.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n")))


def _score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a a / (l r)), exact."""
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    spread = F.lit(1000000).cast("decimal(7,0)") * exact(a) * exact(a)
    return F.call_function("div", spread, exact(left) * exact(right)).cast("long")


def collocations(docs: DataFrame, least: int = 10, inside: tuple[int, int] = (50, 100), top: int = 2000, lang: Column | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `top` phrases of two and three words that come at least `least` times.

    Texts are lower-cased (A-Z), cut into pieces at marks and line ends, and pieces into words at spaces and tabs; phrases lie in one
    piece. a counts the phrase, l and r the parts of its weakest cut (the first of equals), n the language's words; score is
    floor(10^6 a^2 / (l r)), exact up to counts of 10^15. A pair that a phrase of three words holds at least inside[0] times of inside[1]
    is left out. Order is by score, a, and the phrase's bytes. A null text is empty, a null lang is `und`; rows that repeat
    count again; languages without words, and an empty table, give no rows.
    """
    name = F.coalesce(F.col("lang") if lang is None else lang, F.lit("und")).alias("lang")
    found = stripes(docs.select(name, "text"), least)
    words = found.groupBy("lang", F.col("w1").alias("w")).agg(F.sum("n").alias("f"))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stage(words.where(F.col("f") >= least))
    triples = found.where(F.col("w3").isNotNull() & (F.col("n") >= least)).select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
    totals = found.where(F.col("w2").isNotNull()).groupBy("lang", "w1", "w2").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    left, right = words.withColumnsRenamed({"w": "w1", "f": "l"}), words.withColumnsRenamed({"w": "w2", "f": "r"})
    pairs = stage(totals.join(left.hint("merge"), ["lang", "w1"]).join(right.hint("merge"), ["lang", "w2"]))

    first = pairs.select("lang", "w1", "w2", F.col("l").alias("l1"), F.col("a").alias("l2"))
    last = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    longer = triples.join(first.hint("merge"), ["lang", "w1", "w2"]).join(last.hint("merge"), ["lang", "w2", "w3"])
    longer = longer.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    at_first = F.col("s1") <= F.col("s2")
    weakest = lambda k: F.when(at_first, F.col(f"{k}1")).otherwise(F.col(f"{k}2")).alias({"s": "score"}.get(k, k))
    longer = longer.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", weakest("l"), weakest("r"), weakest("s"))

    held = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("x"), "a")
    most = held.groupBy("lang", F.col("x.w1").alias("w1"), F.col("x.w2").alias("w2")).agg(F.max("a").alias("most"))
    own = pairs.join(most.hint("merge"), ["lang", "w1", "w2"], "left").where(F.coalesce(inside[1] * F.col("most") < inside[0] * F.col("a"), F.lit(True)))
    own = own.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = own.unionByName(longer).withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
