"""Best-fit packing of token sequences by a linear grouping scheme."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import python_batches, salted_prefix, stage

#: Words whose ids a worker remembers (the last used ones: two halves, of which the older one is dropped), and the longest that it does.
REMEMBERED, LONGEST = 120_000, 64
#: Characters for which the tokenizer's way to words is plain: no special tokens, no composing marks, one-to-one lower case.
_LETTERS = "a-zß-öø-ÿā-įı-ĸĺ-ňŋ-ž"
_OTHER = re.compile(r"<\||[^\t-\r -~À-ÖØ-öø-įı-ĸĺ-ňŊ-ž‐-‧€]")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_seen: dict[str, bytes] = {}
_before: dict[str, bytes] = {}
_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer, and of each id whether it ends a word."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        _tokenizers[path] = tokenizer, ends
        _seen.clear()
        _before.clear()
    return _tokenizers[path]


def _token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text, without special tokens, as little-endian unsigned 32-bit numbers.

    This tokenizer lowers a text, cuts it into words by a pattern and encodes each word by itself. Texts of plain characters
    are cut here, and each distinct word is encoded once; all others go to the tokenizer as they are.
    """
    tokenizer, ends = _tokenizer(path)
    words = [None if _OTHER.search(t or "") else _WORD.findall((t or "").lower()) for t in texts]
    odd = [k for k, w in enumerate(words) if w is None]
    ids = lambda e: np.array(e.ids, dtype="<u4").tobytes()
    whole = dict(zip(odd, map(ids, tokenizer.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False))))
    global _seen, _before
    if len(_seen) > REMEMBERED // 2:
        _seen, _before = {}, _seen
    new = {w for own in words if own for w in own}.difference(_seen)
    again = new.intersection(_before)
    _seen.update((w, _before[w]) for w in again)
    new -= again
    long = [w for w in new if len(w) > LONGEST]
    some = list(new.difference(long))
    lines = [" ".join(some[k : k + 200]) for k in range(0, len(some), 200)]
    for k, e in enumerate(tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
        own, row = some[200 * k : 200 * k + 200], np.array(e.ids, dtype="<u4")
        cut = (np.flatnonzero(ends[row]) + 1) * 4
        if len(cut) == len(own):
            raw, at = row.tobytes(), 0
            for w, z in zip(own, cut.tolist()):
                _seen[w] = raw[at:z]
                at = z
        else:
            _seen.update((w, ids(tokenizer.encode(w, add_special_tokens=False))) for w in own)
    rare = {w: ids(tokenizer.encode(w, add_special_tokens=False)) for w in long}
    get = {**_seen, **rare}.__getitem__ if rare else _seen.__getitem__
    return [whole[k] if own is None else b"".join(map(get, own)) for k, own in enumerate(words)]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, chunk_chars: int = 2_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each text and end_id, cut after every `capacity` ids."""
    python_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, texts, at = [], batch.column(1), 0
            while at < batch.num_rows:
                part, chars = [], 0
                while at + len(part) < batch.num_rows and (not part or chars < chunk_chars):
                    part.append(texts[at + len(part)].as_py())
                    chars += len(part[-1] or "")
                for k, ids in enumerate(_token_bytes(part, path)):
                    ids += end
                    for piece, b in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[b : b + 4 * capacity]
                        rows.append((at + k, piece, b // 4, len(cut) // 4, zlib.crc32(cut)))
                at += len(part)
            row, *rest = zip(*rows)
            arrays = [batch.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Packs a histogram of lengths: runs of equal items onto runs of bins, an item a bin.

    Its size depends on the capacity (there are at most so many lengths), not on the number of items.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int = 48, large: float = 1 / 8):
        self.capacity = capacity
        self.bins = 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, items, first bin, offset
        self.placed: dict[int, int] = defaultdict(int)  # items of each length so far
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first bin, bins)
        self.rooms: list[int] = []
        left = dict(histogram)
        big = [(s, left[s]) for s in sorted(left, reverse=True) if s > large * capacity]
        self._group(big, groups, left)
        for size in sorted(left, reverse=True):
            self._best_fit(size, left[size])

    def _put(self, size: int, items: int, first_bin: int, offset: int) -> None:
        self.runs.append((size, self.placed[size], items, first_bin, offset))
        self.placed[size] += items

    def _keep(self, room: int, first_bin: int, bins: int) -> None:
        if room and bins:
            if not self.open[room]:
                bisect.insort(self.rooms, room)
            self.open[room].append((first_bin, bins))

    def _take(self, room: int) -> tuple[int, int]:
        got = self.open[room].pop()
        if not self.open[room]:
            self.rooms.remove(room)
        return got

    def _group(self, big: list[tuple[int, int]], groups: int, left: dict[int, int]) -> None:
        """Linear grouping: the large items by descending length in groups of equal number, each rounded up to its longest."""
        total = sum(c for _, c in big)
        if not total:
            return
        queues: list[list[list[int]]] = []  # per group: [length, items]
        done, at = 0, 0
        for size, count in big:
            while count:
                end = total * (at + 1) // groups
                now = min(count, end - done)
                if now:
                    if len(queues) <= at:
                        queues += [[] for _ in range(at + 1 - len(queues))]
                    queues[at].append([size, now])
                    done, count = done + now, count - now
                if done >= end:
                    at += 1
        merged: dict[int, list[list[int]]] = {}
        for q in queues:
            if q:
                merged.setdefault(q[0][0], []).extend(q)
        sizes = list(merged)
        demand = [sum(c for _, c in merged[s]) for s in sizes]
        for pattern, times in configurations(sizes, demand, self.capacity):
            self._fill(pattern, times, sizes, merged, left)

    def _fill(self, pattern, times: int, sizes: list[int], merged, left: dict[int, int]) -> None:
        """Puts actual items in place of the rounded ones of `times` bins of one configuration."""
        spans = [(self.bins, times, 0)]  # first bin, bins, used
        self.bins += times
        for size, n in zip(sizes, pattern):
            for _ in range(n):
                queue, out = merged[size], []
                for first, bins, used in spans:
                    while bins:
                        actual, have = queue[0]
                        now = min(have, bins)
                        self._put(actual, now, first, used)
                        left[actual] -= now
                        out.append((first, now, used + actual))
                        first, bins = first + now, bins - now
                        queue[0][1] -= now
                        if not queue[0][1]:
                            queue.pop(0)
                spans = out
        for first, bins, used in spans:
            self._keep(self.capacity - used, first, bins)

    def _best_fit(self, size: int, count: int) -> None:
        """Puts each item where least room is left over, else in a new bin; a bin takes on while it has room."""
        while count:
            k = bisect.bisect_left(self.rooms, size)
            room = self.rooms[k] if k < len(self.rooms) else self.capacity
            per = room // size
            if k < len(self.rooms):
                first, bins = self._take(room)
            else:
                first, bins = self.bins, max(1, count // per)
                self.bins += bins
            each = min(bins, count // per)
            if not each:  # a last bin, not filled up
                each, per = 1, count
            for n in range(per):
                self._put(size, each, first, self.capacity - room + n * size)
            self._keep(room - per * size, first, each)
            self._keep(room, first + each, bins - each)
            count -= per * each


#: Numbers of groups, and what part of the capacity counts as large, that are tried; all cost little beside the tokens.
CHOICES = [(24, 1 / 8), (48, 1 / 8), (192, 1 / 4), (96, 1 / 8)]


def best_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan with the fewest bins over CHOICES; the first within a thousandth of the volume ends the search."""
    least = sum(k * v for k, v in histogram.items()) / capacity
    best = None
    for groups, large in CHOICES:
        plan = Plan(histogram, capacity, groups, large)
        if best is None or plan.bins < best.bins:
            best = plan
        if best.bins <= 1.001 * least + 1:
            break
    return best


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400):
    """(pattern, bins): how often to use which combination of the sizes, whole numbers that don't exceed the demand.

    The linear relaxation is solved by column generation: a simplex basis of patterns, and the best new pattern for its
    prices by a knapsack over the capacity. Rounded down; what is left of the demand is packed by best fit later.
    """
    k, d = len(sizes), np.array(demand, dtype=float)
    basis = np.diag([float(capacity // s) for s in sizes])
    most = max(capacity // s for s in sizes)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        pattern, value = _knapsack(sizes, prices, capacity, most)
        if value <= 1 + 1e-7:
            break
        amount, change = np.linalg.solve(basis, d), np.linalg.solve(basis, pattern)
        ratio = np.where(change > 1e-9, np.maximum(amount, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = pattern
    amount = np.floor(np.maximum(np.linalg.solve(basis, d), 0) + 1e-6).astype(np.int64)
    left = np.array(demand, dtype=np.int64)
    for column in np.argsort(-amount, kind="stable"):
        pattern = np.rint(basis[:, column]).astype(np.int64)
        used = pattern > 0
        times = int(min(amount[column], (left[used] // pattern[used]).min()))
        if times > 0:
            left -= times * pattern
            yield pattern.tolist(), times


def _knapsack(sizes: list[int], prices: np.ndarray, capacity: int, most: int) -> tuple[np.ndarray, float]:
    best, picks = np.zeros(capacity + 1), []
    for _ in range(most):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for g, (s, p) in enumerate(zip(sizes, prices)):
            if p > 0:
                got = best[: capacity + 1 - s] + p
                better = got > new[s:] + 1e-12
                new[s:][better] = got[better]
                pick[s:][better] = g
        best = new
        picks.append(pick)
    pattern, at = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[at] >= 0:
            pattern[pick[at]] += 1
            at -= sizes[pick[at]]
    return pattern, float(best[capacity])


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, salts: int = 64) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every token of docs (doc_id, text) packed into sequences.

    Only documents longer than capacity are cut. The counts of each length (at most `capacity` of them) go to the driver, where
    the large lengths are rounded up within groups of equal cardinality, configurations of these few sizes are
    optimised, actual lengths take the places, and the small ones go by best fit; items then find their place by their rank
    among those of their length. A null text counts as empty and is one piece, the end id. Ids may be null or repeat; repeated
    rows are packed each. Other columns are not used. An empty table gives an empty result.
    """
    pieces = stage(token_pieces(docs, path, capacity, end_id).withColumn("item", F.monotonically_increasing_id()))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(sorted(best_plan(histogram, capacity).runs), dtype=np.int64).reshape(-1, 5)
    lengths, first, _, bins, offsets = runs.T
    step = int(first.max(initial=0)) + max([0, *histogram.values()]) + 1
    key = lengths * step + first  # ordered like (length, first rank)
    ranked = salted_prefix(pieces, ["length"], [F.col("item")], F.lit(1), salts, "rank").drop("item")

    def place(batches):
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, n * step + rank, side="right") - 1
            columns = batch.columns[: batch.schema.get_field_index("rank")]
            more = [pa.array(bins[at] + rank - first[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*batch.schema.names[: len(columns)], "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*columns, "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
