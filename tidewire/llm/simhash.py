"""SimHash near-duplicates by a generalised pigeonhole search."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import forest, python_batches, release, stage, whole_groups
from tidewire.llm.components import connected_components
from tidewire.llm.tiles import per_pair, tile_pairs

BITS = 64
#: Shingles hashed at a time, so that the bits of a very long text never lie in memory all at once.
CHUNK = 1 << 15


def _shingles(text: str | None, words: int, seed: int = 42):
    """The hashes of all shingles, in pieces; of a text with fewer words, of all of it; none of a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not found:
        return
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = found[at : min(n, at + CHUNK) + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(found) >= words else [b" ".join(found)]
        yield np.array([digest(s, seed) for s in shingles], dtype=">u8")


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles' hashes, as sorted signed longs."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(text, words)]).astype(np.uint64).view(np.int64))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """In how many of the big-endian hashes each bit is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint as a signed long; 0 for a text without words, or none."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in _shingles(text, words, seed):
        ones += _ones(hashes)
        n += len(hashes)
    return _majority(ones, n)


def both_fingerprints(text: str | None, words: int = 5) -> tuple[int, int, np.ndarray]:
    """The fingerprint of a text's distinct shingles, a second one from other bits of them, and the sorted hashes themselves."""
    own = shingle_set(text, words)
    ones, more = np.zeros(BITS, dtype=np.int64), np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(own), CHUNK):
        h = own[at : at + CHUNK].view(np.uint64)
        ones += _ones(h.astype(">u8"))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        more += _ones((h ^ (h >> np.uint64(32))).astype(">u8"))
    return _majority(ones, len(own)), _majority(more, len(own)), own


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id_col, fp: the signed 64-bit fingerprint of every whole text."""
    python_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = [simhash(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[float, np.ndarray]:
    """How many fingerprints there are, and in how many both bit i and bit j are set, over all of them."""

    def run(batches):
        import pandas as pd

        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bits(batch["fp"].to_numpy()).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(both.ravel(), n)})

    # BITS^2 + 1 rows come to the driver, whatever the input.
    rows = fps.select("fp").mapInPandas(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    total = float(rows.loc[rows.i < 0, "n"].sum())
    both = np.zeros((BITS, BITS))
    rows = rows[rows.i >= 0]
    both[rows.i, rows.j] = rows.n
    return total, both


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="big")[:, ::-1]


def group_bits(n: float, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the 64 bits into parts of near-equal width so that correlated bits share a part.

    Greedy: each part starts at the free bit with the strongest correlations and takes the bits closest to it.
    """
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            part.append(max(free, key=lambda b: (corr[b, part].sum(), -b)))
            free.remove(part[-1])
        out.append(sorted(part))
    return out


def part_key(part: list[int], fp: Column) -> Column:
    """The bits of a part, side by side, as a long."""
    key = F.lit(0).cast("long")
    for k, b in enumerate(part):
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), k))
    return key


def allocate(costs: list[list[float]], budget: int) -> list[int]:
    """Thresholds t >= -1 (-1: the part isn't probed) with the given sum and least total cost, by dynamic programming.

    costs[i][t + 1] is the estimated number of candidates of part i at threshold t.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t1, c in enumerate(part):
                got = (cost + c, [*chosen, t1 - 1])
                if (s := spent + t1 - 1) not in new or got[0] < new[s][0]:
                    new[s] = got
        best = new
    return best[budget][1]


def estimated_costs(fps: DataFrame, n: float, both: np.ndarray, layout: list[list[int]], distance: int) -> list[list[float]]:
    """For each part, candidates at thresholds -1, 0, .. distance.

    At 0 they are counted over all fingerprints (the sum of the squares of the sizes of buckets); further out the count
    grows as it would if the part's bits were independent with the frequencies measured.
    """
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), part_key(p, F.col("fp")).alias("key")) for i, p in enumerate(layout))))
    sizes = fps.select(keys.alias("k")).groupBy("k.part", "k.key").agg(F.count(F.lit(1)).cast("double").alias("c"))
    counted = {r.part: r.c for r in sizes.groupBy("part").agg(F.sum(F.col("c") * F.col("c")).alias("c")).collect()}
    p = np.diag(both) / max(n, 1)
    out = []
    for i, part in enumerate(layout):
        at = np.zeros(distance + 2)
        at[0] = 1.0
        for b in part:
            differ = 2 * p[b] * (1 - p[b])
            at[1:] = at[1:] * (1 - differ) + at[:-1] * differ
            at[0] *= 1 - differ
        within = np.cumsum(at[: distance + 1])
        base = counted.get(i, 0.0)
        # Where a threshold above 0 is allocated, each fingerprint also stands under every key within half of it.
        rows = [n * sum(math.comb(len(part), r) for r in range((t + 1) // 2 + 1)) for t in range(distance + 1)]
        out.append([0.0, *(float(base * w / max(within[0], 1e-300) + r) for w, r in zip(within, rows))])
    return out


def _verify(distance: int):
    """Kernel over whole pairs of tiles: links within `distance`, as the node and the smallest node reached in the pair."""

    def kernel(pdf):
        import pandas as pd

        fp = pdf["fp"].to_numpy()
        keys = [pdf[k].to_numpy() for k in ("part", "key", "tile_a", "tile_b")]
        new = np.ones(len(fp), dtype=bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group]
        begin = np.flatnonzero(new)[group]
        links_i, links_j = [], []
        open_, shift = np.flatnonzero(size > 1), 1
        while len(open_):  # each row against the one `shift` places on, while that is of its group
            open_ = open_[open_ + shift < begin[open_] + size[open_]]
            x, y = fp[open_], fp[open_ + shift]
            hit = open_[np.bitwise_count((x ^ y).view(np.uint64)) <= distance]
            links_i.append(hit)
            links_j.append(hit + shift)
            shift += 1
        i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (links_i, links_j))
        root = forest(i, j, len(fp))
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[moved], "b": fp[root[moved]]})

    return kernel


def fingerprint_links(fps: DataFrame, distance: int = 2, parts: int | None = None, tile_rows: int = 4096) -> DataFrame:
    """a, b: links between the distinct fingerprints `fp` that join all which lie within `distance` bits, directly or by others.

    Generalised pigeonhole: with m parts and thresholds that sum to distance - m + 1, two fingerprints within the distance
    agree within the threshold in one part at least. Within each bucket links are reduced to a forest before they
    leave the task, so a large group of near copies yields a row per member and not one per pair; none is lost.
    """
    parts = max(2, parts or distance + 1)
    n, both = bit_statistics(fps)
    layout = group_bits(n, both, parts)
    thresholds = allocate(estimated_costs(fps, n, both, layout, distance), distance - parts + 1)
    entries = []
    for i, (part, t) in enumerate(zip(layout, thresholds)):
        if t < 0:
            continue
        key = part_key(part, F.col("fp"))
        # Two keys within t bits share a key within ceil(t / 2) of each.
        masks = [0, *((1 << k) for k in range(len(part)))] if t > 0 else [0]
        for _ in range((t + 1) // 2 - 1):
            masks = sorted({m ^ (1 << k) for m in masks for k in range(len(part))} | set(masks))
        entries += [F.struct(F.lit(i).alias("part"), key.bitwiseXOR(F.lit(m).cast("long")).alias("key")) for m in masks]
    probes = fps.select("fp", F.explode(F.array(*entries)).alias("__e")).select("__e.part", "__e.key", "fp")
    pairs = tile_pairs(probes, ["part", "key"], "fp", tile_rows)
    return per_pair(pairs, ["part", "key"], _verify(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp, component_id (the smallest id among the documents whose fingerprints this one's can reach), component (the smallest of these fingerprints).

    A null text counts as one without words, of fingerprint 0, which links like any other. Repeated rows and ids
    come out as often as they came in. A component whose ids are all null has a null id. Other columns of docs are
    not used. An empty table gives an empty result.
    """
    prints = stage(fingerprints(docs, id_col, text_col))
    firsts = stage(prints.groupBy("fp").agg(F.min(id_col).alias("first")))
    reached = stage(connected_components(fingerprint_links(firsts.select("fp"), distance)))
    reached = reached.select(F.col("node").alias("fp"), "component")
    grouped = firsts.join(reached, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "component").select("fp", "component_id", "component")
    return prints.join(named, "fp").select(id_col, "fp", "component_id", "component")


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether the Jaccard similarity of two sets is at least the fraction `least`."""
    if min(len(a), len(b)) * least[1] < max(len(a), len(b)) * least[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least[1] >= (len(a) + len(b) - both) * least[0]


def _texts_sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """content, shingles: the sets of the wanted contents (content, tie) from texts (tie, text), where tie is a hash of the text."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["content", "shingles"])

    found = texts.join(wanted.hint("merge"), "tie").groupBy("content").agg(F.min("text").alias("text"))
    return found.select("content", "text").mapInArrow(run, "content long, shingles array<long>")


class Search:
    """How the distinct fingerprints of a table are searched: bits dealt to parts, thresholds, and how many rows stand in each cell.

    A cell is a part, a key and a class of set sizes. Classes are RATIO wide; a set that is large enough to be similar to the
    smallest of the next class stands there too, as a guest. There are at most parts * 2^width * classes cells, whatever the input.
    """

    #: Width of a class of set sizes; similar sets differ by less than that.
    RATIO = 2.5
    CLASSES = 24

    def __init__(self, nodes: DataFrame, distance: int, parts: int, least: tuple[int, int], tile_rows: int):
        self.distance, self.least, self.tile_rows = distance, least, tile_rows
        self.bounds = np.ceil(self.RATIO ** np.arange(self.CLASSES)).astype(np.int64)
        n, both = bit_statistics(nodes)
        self.layout = group_bits(n, both, parts)
        keys = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), part_key(p, F.col("fp")).alias("key")) for i, p in enumerate(self.layout))))
        kind = F.size(F.filter(F.array(*(F.lit(int(b)).cast("long") for b in self.bounds)), lambda b: b <= F.col("size")))
        counted = nodes.select(kind.alias("kind"), keys.alias("k")).groupBy("k.part", "k.key", "kind").agg(F.count(F.lit(1)).alias("n")).toPandas()
        self.own = [np.zeros((1 << len(p), self.CLASSES + 1), dtype=np.int64) for p in self.layout]
        for i, own in enumerate(self.own):
            rows = counted[counted.part == i]
            own[rows.key.to_numpy(np.int64), rows.kind.to_numpy(np.int64)] = rows.n
        budget = distance - parts + 1
        most = -(-budget // parts) + 2
        self.thresholds = allocate([self._costs(own, len(p), n, most) for own, p in zip(self.own, self.layout)], budget)
        self.masks = [_ball(len(p), (t + 1) // 2) if t >= 0 else [] for p, t in zip(self.layout, self.thresholds)]
        self.tiles = []
        for own, masks in zip(self.own, self.masks):
            here = sum((own[np.arange(len(own)) ^ m] for m in masks), np.zeros_like(own))
            here[:, 1:] += here[:, :-1]  # guests: no more than the class below has
            self.tiles.append(np.maximum(1, -(-here // tile_rows)).astype(np.int32))
        del self.own

    @staticmethod
    def _costs(own: np.ndarray, width: int, n: float, most: int) -> list[float]:
        """What a part costs at thresholds -1, 0, .. most: the pairs that meet in its cells, counted over all fingerprints, and the rows in them."""
        at, table = np.arange(len(own)), own.astype(np.float64)
        apart = [float(sum((table * table[at ^ m]).sum() for m in _shell(width, d))) / 2 for d in range(min(width, 2 * ((most + 1) // 2)) + 1)]
        out = [0.0]
        for t in range(most + 1):
            r = (t + 1) // 2
            meet = [sum(math.comb(d, x) * math.comb(width - d, y) for x in range(d + 1) for y in range(width - d + 1) if max(x, d - x) + y <= r) for d in range(len(apart))]
            out.append(sum(p * m for p, m in zip(apart, meet)) + 10 * n * len(_ball(width, r)))
        return out

    def spread(self, rows: DataFrame) -> DataFrame:
        """rows (content, fp, more long; size int; perhaps comp long) in every cell and pair of tiles where they stand: cell, pair, in_a, own, and the row."""
        names = [c for c in ("content", "fp", "more", "comp", "size") if c in rows.columns]

        def run(batches):
            for batch in batches:
                content, fp, size = (batch.column(names.index(c)).to_numpy() for c in ("content", "fp", "size"))
                kind = np.searchsorted(self.bounds, size, side="right")
                guest = (kind < len(self.bounds)) & (size * self.least[1] >= self.bounds[np.minimum(kind, len(self.bounds) - 1)] * self.least[0])
                rows_ = np.concatenate([np.arange(len(fp)), np.flatnonzero(guest)])
                kinds = np.concatenate([kind, kind[guest] + 1])
                own = np.arange(len(rows_)) < len(fp)
                dealt = (content.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for i, part in enumerate(self.layout):
                    key = np.zeros(len(fp), dtype=np.int64)
                    for k, b in enumerate(part):
                        key |= ((fp >> np.int64(b)) & np.int64(1)) << np.int64(k)
                    for m in self.masks[i]:
                        at = key[rows_] ^ np.int64(m)
                        n = self.tiles[i][at, kinds]
                        pick = np.repeat(np.arange(len(rows_)), n)
                        other = np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n)
                        tile = (dealt[rows_[pick]] % n[pick].astype(np.uint64)).astype(np.int64)
                        a, b = np.minimum(tile, other), np.maximum(tile, other)
                        cell = ((np.int64(i) << np.int64(40)) | (at[pick] << np.int64(8)) | kinds[pick]).astype(np.int64)
                        row = pa.array(rows_[pick])
                        arrays = [pa.array(cell), pa.array((a << 31) | b), pa.array(tile == a), pa.array(own[pick]), *(batch.column(names.index(c)).take(row) for c in names)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["cell", "pair", "in_a", "own", *names])

        return rows.select(*names).mapInArrow(run, _CELL_ROWS if "comp" in names else _CELL_ROWS.replace("comp long, ", ""))

    def may_link(self, pdf, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of rows of a cell can be similar: by the probed fingerprint, by the second one and by the sizes of their sets."""
        fp, more, size, own = pdf
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        near = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= self.distance
        near &= low * self.least[1] >= high * self.least[0]
        near &= own[i] | own[j]
        near[near] = np.bitwise_count((more[i[near]] ^ more[j[near]]).view(np.uint64)) <= self.distance + SLACK
        return near


_CELL_ROWS = "cell long, pair long, in_a boolean, own boolean, content long, fp long, more long, comp long, size int"
#: Members up to which a tree of candidates is compared as it is, in up to 16 tiles; a matter of layout alone.
WHOLE_TREE = 8192
#: Bits by which the second fingerprints of similar sets may differ beyond the distance of the first.
SLACK = 6


def _shell(width: int, t: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in itertools.combinations(range(width), t)]


def _ball(width: int, radius: int) -> list[int]:
    return [m for t in range(radius + 1) for m in _shell(width, t)]


def _trees(search: Search):
    """Kernel over whole cells: candidate pairs that join what the candidates of a cell join, as a forest: a row less than members.

    All rows are held against the first of the cell; what lies near it is joined to it, and only the other rows are compared one by
    one, so that a large group of near copies takes time in proportion to its size.
    """

    def kernel(pdf):
        import pandas as pd

        content = pdf["content"].to_numpy()
        group = _groups(pdf["cell"].to_numpy(), pdf["pair"].to_numpy())
        columns = [pdf[c].to_numpy() for c in ("fp", "more", "size", "own")]
        begin = (np.cumsum(np.bincount(group)) - np.bincount(group))[group]
        every = np.arange(len(group))
        close = (begin != every) & search.may_link(columns, every, begin)
        order = np.lexsort((~(close | (begin == every)), group))
        content, close = content[order], close[order]
        columns = [c[order] for c in columns]
        joined = np.flatnonzero(close)
        out = [(content[joined], content[begin[joined]])]
        root = every.copy()
        root[joined] = begin[joined]
        rest, shift = np.flatnonzero(~close & (begin != every)), 1
        while len(rest := rest[rest - shift >= begin[rest]]):
            before = rest - shift
            hit = (root[rest] != root[before]) & search.may_link(columns, rest, before)
            x, y = rest[hit], before[hit]
            kept = []
            for k, (p, q) in enumerate(zip(x.tolist(), y.tolist())):
                p, q = _top(root, p), _top(root, q)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    kept.append(k)
            out.append((content[x[kept]], content[y[kept]]))
            shift += 1
        a, b = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b]

    return kernel


def _top(root: np.ndarray, k: int) -> int:
    while root[k] != k:
        root[k] = k = int(root[root[k]])
    return k


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Numbers the runs of equal keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.cumsum(new) - 1


def _open_pairs(search: Search):
    """Rows of whole cells that can link: (i, j) of different components, in pieces."""

    def pairs(pdf):
        comp, in_a, pair = (pdf[c].to_numpy() for c in ("comp", "in_a", "pair"))
        columns = [pdf[c].to_numpy() for c in ("fp", "more", "size", "own")]
        group = _groups(pdf["cell"].to_numpy(), pair)
        end = np.cumsum(np.bincount(group))[group]
        one = (pair >> 31) == (pair & ((1 << 31) - 1))
        open_, shift = np.arange(len(group)), 1
        while len(open_ := open_[open_ + shift < end[open_]]):
            j = open_ + shift
            hit = (comp[open_] != comp[j]) & (one[open_] | (in_a[open_] != in_a[j])) & search.may_link(columns, open_, j)
            if hit.any():
                yield open_[hit], j[hit]
            shift += 1

    return pairs


def _candidates(search: Search):
    """Kernel: the rows that have a pair to be verified."""
    pairs = _open_pairs(search)

    def kernel(pdf):
        open_ = np.zeros(len(pdf), dtype=bool)
        for i, j in pairs(pdf):
            open_[i] = open_[j] = True
        return pdf[open_]

    return kernel


def _verified(search: Search):
    """Kernel over cells with the sets: links between similar contents, none where others join the two already."""
    pairs = _open_pairs(search)

    def kernel(pdf):
        import pandas as pd

        content, sets = pdf["content"].to_numpy(), pdf["shingles"].to_numpy()
        names, root = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        top, out = np.arange(len(names)), []
        for i, j in pairs(pdf):
            for x, y in zip(i.tolist(), j.tolist()):
                a, b = _top(top, root[x]), _top(top, root[y])
                if a != b and similar(sets[x], sets[y], search.least):
                    top[a] = b
                    out.append((content[x], content[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return kernel


_CELLS = ["cell", "pair"]


def _per_cell(rows: DataFrame, kernel, schema: str) -> DataFrame:
    return rows.repartition(*_CELLS).sortWithinPartitions(*_CELLS).mapInPandas(whole_groups(kernel, _CELLS, least_rows=1 << 15), schema)


def similar_links(marked: DataFrame, texts: DataFrame, words: int, distance: int, least: tuple[int, int], parts: int, tile_rows: int = 4096) -> DataFrame:
    """a, b: links between contents, of marked (content, fp, more, size, tie) and texts (tie, text), that join all whose fingerprints lie within `distance` and whose sets are similar.

    The candidates of each cell leave it as a forest, whose pairs are verified by their sets. Where all pairs of a tree hold, so does every
    link among its members, and nothing is left to compare. Among the members of trees with a pair that doesn't hold, all
    candidates that are not joined yet are verified.
    """
    nodes = stage(marked.where("content != 0").groupBy("content").agg(F.min("fp").alias("fp"), F.min("more").alias("more"), F.min("size").alias("size"), F.min("tie").alias("tie")))
    search = Search(nodes, distance, parts, least, tile_rows)
    pairs = stage(_per_cell(search.spread(nodes), _trees(search), "a long, b long").distinct())
    release(marked.sparkSession)
    ends = pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct()
    held = stage(_texts_sets(texts, nodes.join(ends, "content").select("content", "tie"), words))
    sides = pairs.join(held.withColumnsRenamed({"content": "a", "shingles": "x"}).hint("merge"), "a").join(held.withColumnsRenamed({"content": "b", "shingles": "y"}).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    judged = stage(sides.select("a", "b", (common * least[1] >= (F.size("x") + F.size("y") - common) * least[0]).alias("holds")))
    first = judged.where("holds").select("a", "b")
    if judged.where("NOT holds").isEmpty():
        return first

    trees = stage(connected_components(judged)).withColumnsRenamed({"node": "content", "component": "tree"})
    doubtful = judged.where("NOT holds").select(F.col("a").alias("content")).join(trees, "content").select("tree").distinct()
    sized = trees.groupBy("tree").agg(F.count(F.lit(1)).alias("members")).join(doubtful, "tree")
    joined = connected_components(first).withColumnsRenamed({"node": "content", "component": "joined"})
    again = nodes.join(trees, "content").join(sized, "tree").join(joined, "content", "left")
    again = stage(again.select("tree", "members", "content", "fp", "more", F.coalesce("joined", "content").alias("comp"), "size"))
    # Candidates share a tree, so the pairs of a small tree are simply all of its own; a large one is searched by cells once more.
    small = tile_pairs(again.where(F.col("members") <= WHOLE_TREE), ["tree"], "content", WHOLE_TREE // 16)
    pair = (F.shiftleft(F.col("tile_a").cast("long"), 31) + F.col("tile_b")).alias("pair")
    rows = small.select(F.col("tree").alias("cell"), pair, "in_a", F.lit(True).alias("own"), "content", "fp", "more", "comp", "size")
    links = first
    for part in (rows, Search(again.where(F.col("members") > WHOLE_TREE), distance, parts, least, tile_rows // 4).spread(again.where(F.col("members") > WHOLE_TREE))):
        open_ = stage(_per_cell(part, _candidates(search), _CELL_ROWS))
        if open_.isEmpty():
            continue
        full = open_.join(held.hint("merge"), "content").repartition(*_CELLS).sortWithinPartitions(*_CELLS)  # rows with whole sets: a cell at a time
        links = links.unionByName(full.mapInPandas(whole_groups(_verified(search), _CELLS), "a long, b long"))
    return links


def one_of_similar(docs: DataFrame, words: int = 5, distance: int = 14, least: tuple[int, int] = (4, 5), parts: int = 5) -> DataFrame:
    """The rows of docs (doc_id, text and any others) of which one stands for each class of similar texts: the one with the smallest id, null last.

    Texts are linked where the Jaccard similarity of their distinct shingles of `words` words is at least the fraction `least`:
    always where the shingles are the same, else where their fingerprints lie within `distance` bits. Of rows that share that id the
    smallest fingerprint, content and text stays, of rows that repeat all of these any one. Texts without words are one class.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    python_batches(spark)
    names = docs.columns
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = {"fp": pa.int64(), "more": pa.int64(), "content": pa.int64(), "size": pa.int32()}

    def run(batches):
        for batch in batches:
            found = []
            for t in batch.column(2):
                fp, more, distinct = both_fingerprints(t.as_py(), words)
                content = (xxhash.xxh64_intdigest(distinct.tobytes()) | 1) - (1 << 63) if len(distinct) else 0
                found.append((fp, more, content, len(distinct)))
            columns = zip(*found) if found else [()] * len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, own.values()))], names=["doc_id", "tie", *own])

    # Texts stay where they are: rows go by their id and a hash of the text, and meet their text again where it is wanted.
    keyed = docs.withColumns({"__id": F.xxhash64("doc_id"), "__tie": F.xxhash64("text")})
    marked = stage(keyed.select("doc_id", F.col("__tie").alias("tie"), "text").mapInArrow(run, f"doc_id {kind}, tie long, fp long, more long, content long, size int"))
    links = similar_links(marked, keyed.select(F.col("__tie").alias("tie"), "text"), words, distance, least, parts)
    classes = stage(connected_components(links)).withColumnsRenamed({"node": "content", "component": "class"})
    release(spark)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "content", "tie")
    firsts = marked.groupBy("content").agg(F.min(order).alias("f")).join(classes, "content", "left")
    chosen = firsts.groupBy(F.coalesce("class", "content")).agg(F.min("f").alias("f")).select(F.xxhash64("f.doc_id").alias("__id"), F.col("f.tie").alias("__tie"))
    # Rows that repeat id and text are one before they move.
    rows = keyed.groupBy("__id", "__tie").agg(F.first(F.struct(*names)).alias("__row"))
    return rows.join(chosen.hint("merge"), ["__id", "__tie"]).select(*(F.col("__row")[c].alias(c) for c in names))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
