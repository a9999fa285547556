"""Where an item goes: country tables, topic corrections, outside verdicts, readable members of a group."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import rules as R
from tidewire.operators.pairs import newest_before


@dataclass(frozen=True)
class Routing:
    """homes: category -> its country. kinds: category -> kind. places: (country, kind) -> category. catch_all: category -> kind.

    fallback: kind -> category for a country without a place. by_index: categories that an index name decides first.
    """

    homes: dict[str, str]
    kinds: dict[str, str]
    places: dict[tuple[str, str], str]
    catch_all: dict[str, str]
    fallback: dict[str, str]
    by_index: tuple[str, ...] = ()
    countries: dict[str, tuple[str, ...]] = field(default_factory=dict)
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _look_up(table: dict[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _mentions(text: Column, country: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """How often a country's words stand in a text."""
    counted = F.lit(0.0)
    for c, ws in words.items():
        n = sum(((F.length(text) - F.length(F.replace(F.lower(text), F.lit(w), F.lit("")))) / len(w) for w in ws), F.lit(0.0))
        counted = F.when(country == c, n).otherwise(counted)
    return counted


def enforced(category: Column, head: Column, text: Column, routing: Routing) -> Column:
    """The category that the countries in a text ask for; the same one where nothing speaks against it.

    Catch-all categories give way to the place of the country found. Of a country's own category the text may name another
    country: index names decide first where they are listed; then the item moves to that country's place of the same kind, or, if it has
    none, to the fallback, provided that the headline is only about it or the text never names its own country and the other twice.
    """
    rules = R.RuleSet(countries=routing.countries)
    found = R.country(text, rules)
    place = lambda country, kind: _look_up({f"{c}/{k}": v for (c, k), v in routing.places.items()}, F.concat_ws("/", country, kind))
    want = _look_up(routing.homes, category)
    kind = F.coalesce(_look_up(routing.kinds, category), F.lit("policy"))
    by_index = R.country(text, R.RuleSet(countries=routing.indexes)) if routing.indexes else F.lit(None).cast("string")
    indexed = category.isin(*routing.by_index) & by_index.isNotNull() if routing.by_index else F.lit(False)
    m = lambda where, who: _mentions(where, who, routing.countries)
    head_only = (m(head, found) > 0) & (m(head, want) == 0)
    away = head_only | ((m(text, want) == 0) & (m(text, found) >= 2))
    moved = (
        F.when(_look_up(routing.catch_all, category).isNotNull(), F.when(found.isNotNull(), place(found, _look_up(routing.catch_all, category))))
        .when(want.isNull(), F.lit(None).cast("string"))
        .when(indexed & (by_index == want), F.lit(None).cast("string"))
        .when(indexed & F.coalesce(place(by_index, F.lit("equities")), place(by_index, F.lit("rates"))).isNotNull(), F.coalesce(place(by_index, F.lit("equities")), place(by_index, F.lit("rates"))))
        .when(found.isNull() | (found == want), F.lit(None).cast("string"))
        .otherwise(F.coalesce(place(found, kind), F.when(away, _look_up(routing.fallback, kind))))
    )
    return F.coalesce(moved, category)


def corrected_topic(topic: Column, secondary: Column, title: Column, focus: str, focus_words: str, default: str, regulators: str, regulation: str) -> Column:
    """The focus topic needs a focus word in the title's subject, else the first other secondary topic; a regulator in front makes it regulation."""
    other = F.coalesce(F.try_element_at(F.filter(F.coalesce(secondary, F.array().cast("array<string>")), lambda t: t != focus), F.lit(1)), F.lit(default))
    subject = F.split(F.trim(title), "[,…]")[0]
    return F.when(F.trim(title).rlike(f"^({regulators})"), regulation).when((topic == focus) & ~R.fits(subject, focus_words), other).otherwise(topic)


def apply_verdicts(rows: DataFrame, verdicts: DataFrame, key: str = "key") -> DataFrame:
    """Rows with an outside verdict (key, relevant, category) applied: irrelevant ones go, new categories hold; no verdict keeps a row. Adds moved."""
    right = verdicts.select(F.col(key).alias("__k"), F.col("relevant").alias("__r"), F.col("category").alias("__c"))
    joined = rows.join(right, rows[key] == right["__k"], "left").where(F.coalesce("__r", F.lit(True)))
    new = F.coalesce("__c", "category")
    return joined.withColumn("moved", ~new.eqNullSafe(F.col("category"))).withColumn("category", new).drop("__k", "__r", "__c")


def first_readable(members: DataFrame, group: str = "leader") -> DataFrame:
    """Of each group the readable member that covers most, by score and key."""
    order = [F.col("coverage").desc(), F.col("score").desc(), "key"]
    return members.where("readable").withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("__rn = 1").drop("__rn")


def priority(hint: Column, first: list[str], last: list[str]) -> Column:
    """Tier in the queue: 2 if the hint holds a word of `last`, else 0 with a word of `first`, else 1."""
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.coalesce(hint, F.lit("")), w))
    return F.when(holds(last), 2).when(holds(first), 0).otherwise(1)


def queue_order(tier: Column, ts: Column, key: str = "key") -> list[Column]:
    """Order of the queue: by tier, then newest first, undated last."""
    return [tier.asc(), ts.desc_nulls_last(), F.col(key).asc()]


def publish_order(ts: Column, key: str = "key") -> list[Column]:
    """Order of publishing: oldest first, undated last, so that the newest stands where readers arrive."""
    return [ts.asc_nulls_last(), F.col(key).asc()]


def importance_floor(category: Column, policy: list[str], policy_floor: int, usual: int) -> Column:
    """The least importance that a category asks for: a lower one for policy categories."""
    return F.when(category.isin(policy), policy_floor).otherwise(usual)


def within_budget(rows: DataFrame, by: str, cap: int, order: list[Column]) -> DataFrame:
    """rows with `taken`: the first `cap` of each `by` in the order; the others are deferred, and stay unseen."""
    return rows.withColumn("taken", F.row_number().over(Window.partitionBy(by).orderBy(*order)) <= cap)


def once_a_day(rows: DataFrame, log: DataFrame, hours: int = 24) -> DataFrame:
    """Rows whose cluster has no log row in the hours before, in whole seconds."""
    whole = F.timestamp_seconds(F.unix_timestamp("ts"))
    seen = newest_before(rows.withColumn("__whole", whole), log.withColumn("__whole", whole), "cluster", hours * 3600, "__whole")
    return seen.where("seen IS NULL").select(*rows.columns)


def follow_ups(rows: DataFrame, log: DataFrame, days: int = 10) -> DataFrame:
    """rows with update_of, the key of the newest log row of their cluster within the days before; those that bring no fact (material) go."""
    seen = newest_before(rows, log, "cluster", days * 86400).withColumn("update_of", F.col("seen.key")).drop("seen")
    return seen.where(F.col("update_of").isNull() | F.coalesce("material", F.lit(False)))


def findings(rows: DataFrame, losers: DataFrame, expected_topic: Column) -> DataFrame:
    """(key, finding) of a health check: dominated duplicates, topics that differ from their category, rows that were mirrored."""
    duplicate = rows.join(losers.select(F.col("loser").alias("key")), "key", "left_semi").select("key", F.lit("duplicate").alias("finding"))
    topic = rows.where(~expected_topic.eqNullSafe(F.col("topic"))).select("key", F.lit("topic").alias("finding"))
    return duplicate.unionByName(topic).unionByName(rows.where("mirrored").select("key", F.lit("mirrored").alias("finding")))


def register(published: DataFrame, curated: DataFrame, since: Column, until: Column) -> DataFrame:
    """Published facts with curated rows put in by key; rows outside the window are flagged, not dropped."""
    new = curated.withColumn("out_of_window", ~F.coalesce((F.col("ts") > since) & (F.col("ts") <= until), F.lit(False)))
    return published.join(curated.select("key").distinct(), "key", "left_anti").unionByName(new, allowMissingColumns=True)


def write_marts(marts: dict[str, DataFrame], folder: str) -> None:
    """Each mart as JSON lines under its name."""
    for name, df in marts.items():
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
