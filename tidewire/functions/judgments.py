"""Judgments: reading, checking and cleaning the JSON that a model wrote about an item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = """relevant boolean, relevance_reason string, primary_topic string, secondary_topics array<string>, strategic_score double,
    is_key_issue boolean, main_entities array<string>, event_type string, title string, summary string, key_points array<string>,
    why_it_matters string, tags array<string>, material_update boolean, confidence double"""


def read(raw: Column) -> Column:
    """The first {...} of a reply, code fences and all, as a struct; null if it isn't JSON."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), SCHEMA)


def problem(j: Column, primary_topics: list[str]) -> Column:
    """Why a judgment can't be used, or null. An irrelevant one needs nothing but its flag."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(j.isNull() | j["relevant"].isNull(), "no judgment")
        .when(~j["relevant"], F.lit(None).cast("string"))
        .when(~F.coalesce(j["primary_topic"].isin(primary_topics), F.lit(False)), "bad topic")
        .when(~F.coalesce(j["strategic_score"].between(0, 100), F.lit(False)), "bad score")
        .when(blank(j["title"]), "no title")
        .when(blank(j["summary"]), "no summary")
        .when(blank(j["why_it_matters"]), "no reason")
    )


def cleaned(j: Column, event_types: list[str], aggregations: list[str]) -> Column:
    """The judgment within its bounds: score 0..100 (half to even), confidence 0..1 (0.7 if missing), short lists, known event type."""
    first = lambda c, n: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n)
    secondary = F.filter(F.coalesce(j["secondary_topics"], F.array().cast("array<string>")), lambda t: ~(t.eqNullSafe(j["primary_topic"]) | t.isin(aggregations)))
    return F.struct(
        F.least(F.greatest(F.bround(F.coalesce(j["strategic_score"], F.lit(0.0))), F.lit(0.0)), F.lit(100.0)).cast("int").alias("strategic_score"),
        F.slice(secondary, 1, 3).alias("secondary_topics"),
        first(j["main_entities"], 5).alias("main_entities"),
        first(j["key_points"], 4).alias("key_points"),
        F.transform(first(j["tags"], 5), lambda t: F.regexp_replace(t, "^#+", "")).alias("tags"),
        F.when(j["event_type"].isin(event_types), j["event_type"]).otherwise("other").alias("event_type"),
        F.least(F.greatest(F.coalesce(j["confidence"], F.lit(0.7)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )


def confidence_known(confidence: Column) -> Column:
    """The confidence; an unknown one counts as full, a zero as zero."""
    return F.coalesce(confidence, F.lit(1.0))


def confidence_or_full(confidence: Column, zero_is_missing: bool = True) -> Column:
    return F.coalesce(F.nullif(confidence, F.lit(0.0)) if zero_is_missing else confidence, F.lit(1.0))


def disposition(score: Column, discard: int = 50, post: int = 65) -> Column:
    """The ladder: dropped under discard, stored under post, else posted."""
    return F.when(score < discard, "dropped").when(score < post, "stored").otherwise("posted")


def is_key_issue(incident: Column, flag: Column, score: Column, decisive: Column, key: int = 85) -> Column:
    return incident | (F.coalesce(flag, F.lit(False)) & (score >= key) & decisive)
