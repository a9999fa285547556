"""Helpers that several operators share: staging, stable ranks and small numpy parts."""

from __future__ import annotations

import uuid
import weakref

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.operators.clusters import STAGED, drop_staged, release, shared_dir  # noqa: F401

#: What separates words: the space and the characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    STAGED[id(back)] = (weakref.ref(back), path)
    return back


#: Rows that go to a Python worker at a time, so that it never holds many whole texts.
PYTHON_ROWS = 1000


def python_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to PYTHON_ROWS rows where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= PYTHON_ROWS:
        spark.conf.set(name, str(PYTHON_ROWS))


def salted_prefix(df: DataFrame, groups: list[str], order: list[Column], value: Column, salts: int, out: str) -> DataFrame:
    """Adds to each row the sum of value over the rows before it in its group (long, column `out`).

    The order within a group is by a hash of `order`, cut into `salts` ranges, then by `order`: any group, however
    large, is summed in `salts` tasks, and the totals of the ranges give their starts. Rows that agree in all of
    `order` stand in any order among themselves.
    """
    salt, start, local, total = f"__{out}_salt", f"__{out}_start", f"__{out}_local", f"__{out}_total"
    # Null-safe group keys, so that the join below keeps a null group.
    keys = [f"__{out}_k{i}" for i in range(len(groups))]
    df = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    inside = Window.partitionBy(*groups, salt).orderBy(*order)
    df = df.withColumn(local, F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - value)
    totals = df.groupBy(*groups, salt).agg(F.sum(value).alias(total))
    across = Window.partitionBy(*groups).orderBy(salt).rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.select(*(F.col(g).alias(k) for g, k in zip(groups, keys)), F.col(salt).alias(f"{salt}2"), (F.sum(total).over(across) - F.col(total)).alias(start))
    on = [df[g].eqNullSafe(totals[k]) for g, k in zip(groups, keys)] + [df[salt] == totals[f"{salt}2"]]
    return df.join(totals, on, "inner").withColumn(out, (F.col(local) + F.col(start)).cast("long")).drop(*keys, f"{salt}2", salt, start, local)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For n items and the links i[k]-j[k]: the smallest item that each can reach."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = np.minimum(new, new[root])
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def whole_groups(kernel, keys: list[str], least_rows: int = 1):
    """A function for mapInPandas over partitions sorted by keys: hands kernel frames that hold whole groups only.

    A group is held back until its last row has come, and groups until there are least_rows of them, so memory is bounded by the
    largest group, least_rows and one batch.
    """

    def run(batches):
        import pandas as pd

        held: list[pd.DataFrame] = []  # whole groups, then the start of the last one
        rows, last, open_ = 0, None, 0

        def hand_over(parts):
            out = kernel(pd.concat(parts, ignore_index=True))
            return [out] if len(out) else []

        for batch in batches:
            if not len(batch):
                continue
            found = [batch[k].to_numpy() for k in keys]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in found], axis=0)) + 1
            final = tuple(c[-1] for c in found)
            if held and tuple(c[0] for c in found) != last:
                open_ = len(held)  # all that is held is whole
            if len(ends):
                cut = int(ends[-1])
                held.append(batch.iloc[:cut])
                open_, rows = len(held), rows + cut
                held.append(batch.iloc[cut:])
                rows += len(batch) - cut
            else:
                held.append(batch)
                rows += len(batch)
            last = final
            if open_ and rows >= least_rows:
                yield from hand_over(held[:open_])
                held, open_ = held[open_:], 0
                rows = sum(map(len, held))
        if held:
            yield from hand_over(held)

    return run
