"""Idempotent ledgers: seen keys, published facts, runs, drafts and merges of state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import judgments, urls


def first_wins(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Drops later rows of each key, a key after the other; empty and null keys are exempt, and go round the ranking.

    Only the first row of a key is asked for, so Spark cuts each key down before the shuffle.
    """
    for k in keys:
        exempt = F.col(k).isNull() | (F.col(k).cast("string") == "")
        ranked = items.where(~exempt).withColumn("__rn", F.row_number().over(Window.partitionBy(k).orderBy(*order)))
        items = ranked.where("__rn = 1").drop("__rn").unionByName(items.where(exempt))
    return items


def unseen(items: DataFrame, ledgers: dict[str, DataFrame]) -> DataFrame:
    """Items whose value of a column stands in none of the ledgers, given by column."""
    return reduce(lambda df, kv: df.join(kv[1].select(kv[0]).distinct(), kv[0], "left_anti"), ledgers.items(), items)


def insert_or_ignore(ledger: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The ledger with the first new row of each key that it lacks, over the columns of either."""
    new = rows.join(ledger.select(*key).distinct(), key, "left_anti")
    new = new.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")
    return ledger.unionByName(new, allowMissingColumns=True)


def latest_per_key(facts: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Insert or replace: the newest row of each key."""
    return facts.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def patched(facts: DataFrame, patch: DataFrame, key: str, only_null: bool = False) -> DataFrame:
    """Facts with the patch's non-null values by key, in all its columns or only where the facts have null."""
    columns = [c for c in patch.columns if c != key and c in facts.columns]
    right = patch.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = facts.join(right, facts[key] == right["__k"], "left")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"__{c}")) if only_null else F.coalesce(F.col(f"__{c}"), F.col(c))
    return joined.select(*(pick(c).alias(c) if c in columns else F.col(c) for c in facts.columns))


def forget(ledger: DataFrame, keys: DataFrame, key: str, unless: DataFrame | None = None) -> DataFrame:
    """The ledger without the keys, except those that stand in `unless` (published ones)."""
    gone = keys.select(key).distinct()
    if unless is not None:
        gone = gone.join(unless.select(key).distinct(), key, "left_anti")
    return ledger.join(gone, key, "left_anti")


def merged(local: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """Local rows, and remote ones whose key is new, over the local columns."""
    shared = [c for c in local.columns if c in remote.columns]
    return local.unionByName(remote.join(local.select(*key).distinct(), key, "left_anti").select(*shared), allowMissingColumns=True)


def filled(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Local rows with remote values where they are null."""
    return patched(local, remote, key, only_null=True)


def champions(drafts: DataFrame, by: str = "edition") -> DataFrame:
    """The best draft of each edition: the highest quality, the earliest of equals."""
    return drafts.groupBy(by).agg(F.max_by(F.struct("keys", "quality", "built_at"), F.struct("quality", -F.unix_timestamp("built_at"))).alias("d")).select(by, "d.*")


def slot_of(built_at: Column, hours: tuple[int, ...] = (12, 18, 22, 4), zone: str = "Asia/Seoul") -> Column:
    """The slot hour of a draft: the last one at or before the time it was built, in a zone; before the first of a day, the last of the day before."""
    hour = F.hour(F.from_utc_timestamp(built_at, zone))
    passed = F.array_max(F.filter(F.array(*map(F.lit, sorted(hours))), lambda h: h <= hour))
    return F.coalesce(passed, F.lit(max(hours)))


def merged_drafts(versions: DataFrame, new: DataFrame, by: str = "edition") -> DataFrame:
    """The table of draft versions with new ones: one a slot of an edition, the last built, so that a slot that runs again replaces its own.

    The result doesn't depend on the order in which slots run; champions() of it is the draft that stands.
    """
    columns = [by, "slot", "keys", "quality", "built_at"]
    every = versions.select(*columns).unionByName(new.select(*columns))
    return latest_per_key(every, [by, "slot"], [F.col("built_at").desc(), F.col("quality").desc(), F.col("keys").asc()])


def quality(picks: DataFrame, by: list[str]) -> DataFrame:
    """1000 a pick, the mean fit, and up to 1 for freshness; an unknown age counts as 48 hours."""
    fresh = F.greatest(F.lit(0.0), 1 - F.avg(F.coalesce("age_hours", F.lit(48.0))) / 48)
    return picks.groupBy(*by).agg((1000 * F.count(F.lit(1)) + F.avg("fit") + fresh).alias("quality"))


def rolling(history: DataFrame, minute: Column, keep: int, order: Column) -> DataFrame:
    """One row a minute (the last), and of these the newest `keep`."""
    last = F.row_number().over(Window.partitionBy(minute).orderBy(order.desc()))
    rows = history.withColumn("__rn", last).where("__rn = 1").drop("__rn")
    return rows.orderBy(order.desc()).limit(keep)


def pending_runs(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """Windows (scope, window_end) that no run has covered: each is emitted once."""
    return windows.join(runs.select("scope", "window_end").distinct(), ["scope", "window_end"], "left_anti")


def last_ends(runs: DataFrame) -> DataFrame:
    """scope, last_end: where the next window of each scope opens."""
    return runs.groupBy("scope").agg(F.max("window_end").alias("last_end"))


def open_rows(rows: DataFrame, mark: str) -> DataFrame:
    """Rows that no edition has taken (mark is null or empty) and whose judgment is confident."""
    return rows.where((F.coalesce(F.col(mark).cast("string"), F.lit("")) == "") & (judgments.confidence_known(F.col("confidence")) >= 0.5))


def candidates(rows: DataFrame, mark: str, least: int, since: Column, until: Column, ts: str = "ts") -> DataFrame:
    """Open rows of the window (since, until] with at least that score."""
    return open_rows(rows, mark).where((F.col("score") >= least) & (F.col(ts) > since) & (F.col(ts) <= until))


def restored(draft: DataFrame, rows: DataFrame, mark: str) -> DataFrame:
    """A draft's rows (edition, pos, key) that still are open, with their attributes, in the draft's order (pos)."""
    return draft.join(open_rows(rows, mark), "key")


def backfilled_urls(seen_urls: DataFrame, published: DataFrame) -> DataFrame:
    """seen_urls, or, where it is empty, the URL keys of all published rows."""
    keys = published.select(urls.normalize_url(F.col("url")).alias("url_key")).where("url_key != ''").distinct()
    return keys if seen_urls.isEmpty() else seen_urls


def seen_with(curated: DataFrame, seen: DataFrame, seen_urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both ledgers with the keys and URL keys of curated rows, which must not come in again as new ones."""
    rows = curated.withColumn("url_key", urls.normalize_url(F.col("url")))
    by_url = insert_or_ignore(seen_urls, rows.where("url_key != ''").select("url_key"), ["url_key"], [F.col("url_key")])
    return insert_or_ignore(seen, rows.select("key"), ["key"], [F.col("key")]), by_url
