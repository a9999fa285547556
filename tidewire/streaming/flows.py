"""The item flow as Structured Streaming: landing folder to deduplicated, dated, windowed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.functions import times
from tidewire.operators import ledgers


def landing(spark: SparkSession, path: str, schema: str, per_batch: int | None = None, kind: str = "parquet") -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


def dated(items: DataFrame, now: str | None = None, ts: str = "published_at") -> DataFrame:
    """Clock repair before any watermark, so that a wrong future time never moves it."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return items.withColumn(ts, times.repaired_clock(F.col(ts), at))


def deduplicated(items: DataFrame, key: str = "url_key", ts: str = "published_at", late: str = "72 hours") -> DataFrame:
    """The first row of each key within the watermark: bounded state."""
    return items.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def hourly(items: DataFrame, by: list[str], ts: str = "published_at", late: str = "72 hours") -> DataFrame:
    """Counts of whole hours [start, end) by category."""
    return items.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("window_end"), *by, "n")


def into_ledger(items: DataFrame, ledger: str, key: str, checkpoint: str, emit: Callable[[DataFrame, int], None] | None = None, warm_up: bool = False) -> StreamingQuery:
    """Each batch's new keys, once: anti-joined with the ledger table at a path, appended to it, then handed to emit (see ledger_batch).

    warm_up: the first batch is only marked as seen.
    """

    def each(batch: DataFrame, number: int) -> None:
        ledger_batch(batch, number, ledger, key, None if warm_up and number == 0 else emit)

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_batch(batch: DataFrame, number: int, ledger: str, key: str, emit: Callable[[DataFrame, int], None] | None = None) -> None:
    """One batch: its new keys are written under its number, emitted from what is written, and the batch is marked as emitted.

    A batch that is run again writes its own rows anew, against the other batches only, and isn't emitted again once marked. It is emitted
    twice only if the driver is lost between the end of emit and the mark; emit gets the number, by which a sink can tell.
    """
    spark = batch.sparkSession
    own, mark = f"{ledger.rstrip('/')}/batch={number}", f"{ledger.rstrip('/')}/_emitted/{number}"
    if _landed(spark, mark) is not None:
        return
    rows = ledgers.first_wins(batch, [key], [F.col("published_at").asc_nulls_last(), F.col(key)])
    seen = _landed(spark, ledger)
    if seen is not None and "batch" in seen.columns:
        rows = rows.join(seen.where(F.col("batch") != number).select(key), key, "left_anti")
    rows.write.mode("overwrite").parquet(own)
    if emit:
        emit(spark.read.schema(rows.schema).parquet(own), number)
    spark.range(1).write.mode("overwrite").parquet(mark)


def _landed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def with_lateness(items: DataFrame, limit_hours: Column, arrived: str = "arrived_at", ts: str = "published_at") -> DataFrame:
    """items with late (older at arrival than their class's limit) and event_time: their time, or that of their arrival if they have none.

    An undated item is never late: it counts from its arrival.
    """
    return items.withColumns({"late": times.is_stale(F.col(ts), F.col(arrived), limit_hours), "event_time": F.coalesce(ts, arrived)})


def on_time(items: DataFrame, key: str, longest_hours: int) -> DataFrame:
    """The rows of with_lateness() that are in time, each key once: the watermark is at the longest limit, so state is bounded.

    A row in time is at most that much older than its arrival, and arrivals only grow, so the watermark never passes one that another
    class's limit lets in. Late rows go to late_rows(), a stream of its own without state.
    """
    return items.where("NOT late").withWatermark("event_time", f"{longest_hours} hours").dropDuplicatesWithinWatermark([key])


def late_rows(items: DataFrame) -> DataFrame:
    """The rows of with_lateness() that came too late, for a side table."""
    return items.where("late")


def split_by_lateness(items: DataFrame, key: str, longest_hours: int, main: str, side: str, checkpoint: str) -> list[StreamingQuery]:
    """Runs both streams over what is there: rows in time into the table at main, late ones into the one at side."""
    flows = (("main", on_time(items, key, longest_hours), main), ("side", late_rows(items), side))
    return [df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start() for name, df, path in flows]


def replay(items: DataFrame, since: str, until: str, kept: Column, ledger: str, key: str, published: DataFrame | None = None, emit: Callable[[DataFrame, int], None] | None = None, ts: str = "published_at") -> int:
    """Runs a past interval (since, until] through a gate and into the ledger at a path, as one batch; returns the batch's number.

    kept: the gate, such as that of relaxed rules; the age of items isn't asked. published (key): what is out already and isn't emitted again. The number
    follows from the interval, below those of the stream, so a second run finds its batch marked and changes nothing, and one that
    was broken off writes its own rows anew.
    """
    spark = items.sparkSession
    begin, end = (int(spark.range(1).select(F.unix_timestamp(F.lit(t).cast("timestamp"))).first()[0]) for t in (since, until))
    number = -(begin // 60 * 1_000_000 + (end - begin) // 60 + 1)
    rows = items.where(times.in_window(F.col(ts), F.timestamp_seconds(F.lit(begin)), F.timestamp_seconds(F.lit(end))) & kept)
    if published is not None:
        rows = rows.join(published.select(key).distinct(), key, "left_anti")
    ledger_batch(rows, number, ledger, key, emit)
    return number
