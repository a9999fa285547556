"""Near-duplicates among embeddings by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import forest, stage
from tidewire.llm.components import connected_components
from tidewire.llm.tiles import per_pair, tile_pairs

#: Pairs recomputed at a time.
CHUNK = 1 << 15
#: Room for the rounding of the double-precision sums in the bounds themselves.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit vectors: int8 values, the scale of each vector, and the exact length of what each lost by it."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    return q.astype(np.int8), scale, np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1))


def linked(raw_a: np.ndarray, raw_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with cosine(raw_a[i], raw_b[j]) >= threshold.

    With x = x' + e (x' the quantised vector), |x.y - x'.y'| <= |x||e_y| + |e_x||y'| <= |e_y| + |e_x|(1 + |e_y|).
    Pairs whose bound stays under the threshold are dropped, the others computed in double precision.
    """

    def unit(v):
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

    a, b = unit(raw_a), unit(raw_b)
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(b)
    # Integers of up to 127 * 127 * d are exact in float32 up to d = 1040, and float products run in BLAS.
    exact = np.float32 if a.shape[1] <= 1040 else np.float64
    near = (qa.astype(exact) @ qb.astype(exact).T) * sa[:, None] * sb[None, :]
    bound = eb[None, :] + ea[:, None] * (1 + eb[None, :]) + SLACK
    i, j = np.nonzero(near + bound >= threshold)
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), CHUNK):
        part = slice(at, at + CHUNK)
        keep[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= threshold
    return i[keep], j[keep]


def _compare(threshold: float):
    def kernel(pdf):
        import pandas as pd

        keys = ["label", "dim", "tile_a", "tile_b"]
        out = []
        for (_, _, a, b), part in pdf.groupby(keys, sort=False):
            raw = np.array(part["embedding"].tolist(), dtype=np.float64)
            node, copies = part["node"].to_numpy(), part["copies"].to_numpy()
            first = np.flatnonzero(part["in_a"].to_numpy())
            second = first if a == b else np.flatnonzero(~part["in_a"].to_numpy())
            if not len(second):
                continue
            i, j = linked(raw[first], raw[second], threshold)
            i, j = first[i], second[j]
            if a == b:
                i, j = i[i != j], j[i != j]
            if not len(i):
                continue
            links = np.zeros(len(node), dtype=np.int64)
            np.add.at(links, i, copies[j])
            if a != b:
                np.add.at(links, j, copies[i])
            root = forest(i, j, len(node))
            hit = np.flatnonzero(links)
            out.append(pd.DataFrame({"node": node[hit], "root": node[root[hit]], "links": links[hit]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"node": [], "root": [], "links": []}).astype("int64")

    return kernel


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile_rows: int = 1024) -> DataFrame:
    """One row per vector of (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared only within a label that is not null. Equal vectors of a label are one node with a count,
    so that copies are never paired one by one; links of near copies leave a task as a count and a forest.
    A vector that is null, empty or zero, holds a null or non-finite component, or has a null vec_id links with
    nothing, and neither do vectors of unequal lengths; such a row is its own component. Rows that repeat are further copies.
    Other columns are not used. An empty table gives an empty result.
    """
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
    sound &= F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    nodes = stage(rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    nodes = nodes.withColumn("dim", F.size("embedding"))
    pairs = tile_pairs(nodes.select("label", "dim", "node", "copies", "embedding"), ["label", "dim"], "node", tile_rows)
    found = stage(per_pair(pairs, ["label", "dim"], _compare(threshold), "node long, root long, links long"))
    reached = connected_components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(reached, "node", "left").join(links, "node", "left")
    named = named.select("label", "embedding", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    grouped = rows.where("sound").select("vec_id", "label", "embedding").join(named, ["label", "embedding"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
