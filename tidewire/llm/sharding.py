"""Balanced contiguous shards from global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import stage


def _running(schema_names: list[str]):
    """Adds, within each partition, the bytes and rows before each row, and the partition's number."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, bytes_, rows = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("size")
            ends = pc.add(pc.cumulative_sum(sizes), bytes_)
            more = [pa.array([part] * batch.num_rows, pa.int32()), pc.subtract(ends, sizes), pa.array(range(rows, rows + batch.num_rows), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*schema_names, "part", "bytes_before", "rows_before"])
            bytes_, rows = ends[-1].as_py(), rows + batch.num_rows

    return run


def shard_by_bytes(docs: DataFrame, shards: int = 8, text_col: str = "text", id_col: str = "doc_id", uneven: float = 0.01) -> DataFrame:
    """id_col, size, text_crc32, shard, slot, shard_bytes, group_cut for every row of docs: `shards` contiguous runs of one global order, of near-equal bytes.

    size is the text's UTF-8 bytes plus 1 (null: 1). The order is by a hash of the text, so that equal texts stand side
    by side, then by the id; rows are range-partitioned and sorted by it, the partitions' totals are summed to give each
    partition its start, and the prefix sums are cut at equal targets, a row going to the side that its middle is on. A cut that falls into a
    group of equal texts moves to the nearer edge of the group if that is at most `uneven` of a shard away, however large the group is, so a
    shard is at most twice that away from its share; else the group is cut, as keeping it whole would cost more balance than that. What came
    of it is told: shard_bytes, the bytes of the row's shard, and group_cut, whether its text lies in more than one.
    A null text has a null text_crc32. Null ids come first among equal texts; rows that repeat are rows
    of their own. Other columns are not used. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(id_col, (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    ordered = rows.repartitionByRange("text_hash", id_col).sortWithinPartitions("text_hash", id_col)
    schema = f"{id_col} {kind}, size long, text_crc32 long, text_hash long, part int, bytes_before long, rows_before long"
    local = stage(ordered.mapInArrow(_running(rows.columns), schema))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))  # a row a partition
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_start"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_start"), "bytes")
    placed = local.join(starts.drop("bytes"), "part").select(id_col, "size", "text_crc32", "text_hash", (F.col("bytes_before") + F.col("bytes_start")).alias("at"), (F.col("rows_before") + F.col("rows_start")).alias("row"))

    total = totals.agg(F.sum("bytes")).first()[0] or 0
    targets = [total * k / shards for k in range(1, shards)]
    crossed = placed.where(F.exists(F.array(*map(F.lit, targets)), lambda t: (F.col("at") < t) & (t < F.col("at") + F.col("size"))) if targets else F.lit(False))
    groups = [r.text_hash for r in crossed.select("text_hash").distinct().collect()]  # a group a cut at most
    spans = {r.text_hash: (r.lo, r.hi) for r in placed.where(F.col("text_hash").isin(groups)).groupBy("text_hash").agg(F.min("at").alias("lo"), F.max(F.col("at") + F.col("size")).alias("hi")).collect()}
    cuts = [_cut(t, spans.values(), total / shards * uneven) for t in targets]
    torn = [h for h, (lo, hi) in spans.items() if any(lo < c < hi for c in cuts)]

    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("at") + F.col("size") / 2 >= c).cast("int")
    sharded = placed.withColumn("shard", shard.cast("int"))
    shards_at = {r.shard: (r.row, r.bytes) for r in sharded.groupBy("shard").agg(F.min("row").alias("row"), F.sum("size").alias("bytes")).collect()}  # a row a shard
    of_shard = lambda k: F.coalesce(*(F.when(F.col("shard") == s, F.lit(v[k])) for s, v in shards_at.items()), F.lit(0)).cast("long")
    cut = F.col("text_hash").isin(torn) if torn else F.lit(False)
    return sharded.select(id_col, "size", "text_crc32", "shard", (F.col("row") - of_shard(0)).cast("long").alias("slot"), of_shard(1).alias("shard_bytes"), cut.alias("group_cut"))


def _cut(target: float, spans, near: float) -> float:
    """The nearer edge of the group that target falls into, if it is near enough, else target."""
    for lo, hi in spans:
        if lo < target < hi and min(target - lo, hi - target) <= near:
            return lo if target - lo <= hi - target else hi
    return target
