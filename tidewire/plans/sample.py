"""A small rule set that fits the test tables, and the items, log and pages that the queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import rules as R
from tidewire.functions import text as T
from tidewire.functions import urls

RULES = R.RuleSet(
    gates=(
        R.Gate("shouting", "!!"),
        R.Gate("list", r" \| ", rescue="attion"),
        R.Gate("noise", "[#$%&]{3}", rescue="thanea|eaux"),
        R.Gate("price", "der", also="von", rescue="und"),
    ),
    scores=(
        R.Rule("trade", "thanea|thanedble|attion", 40),
        R.Rule("merger", "eriner|thon|thble", 26),
        R.Rule("rival", "der |von|und", 22),
        R.Rule("world", "que|des|les", 15),
        R.Rule("digital", "was|for", 13),
        R.Rule("rules", "are|with", 11),
        R.Rule("pay", "from|this", 8),
    ),
    penalties=(R.Rule("sport", "!!", -60), R.Rule("hiring", r" \| ", -25)),
    risks="erreth|ndble",
    aliases={"group": {"Thanea": ("thanea", "thanedble")}, "rival": {"Eriner": ("eriner",), "Attion": ("attion",)}, "abroad": {"Reedes": ("reedes", "esndha")}},
    actions={"purchase": "deal", "signup": "partnership", "error": "regulation", "view": "market", "click": "product"},
    material=("erreth", "oredble", "ention"),
    ambiguous=("ention",),
    incident="ndble|eauou",
    scope="the|and|que",
    stop=("the", "of", "and", "de", "la", "en", "to", "in"),
    generic=("that", "was", "are", "les", "des", "der", "die", "und"),
    signal="thon|thre|que",
    keywords=("ing", "tion"),
    acronyms=R"(^|[^A-Za-z0-9])(is|it)($|[^A-Za-z0-9])",
    context="ther|enmentai",
    foreign="que|des|les",
    anchors="eaux|la|de",
    axes=("trade", "rival"),
    generic_axis="rival",
    proper_names="eriner|und",
    category_caps={"trade": 3, "merger": 3, "rival": 2, "world": 2},
    theme_caps={"digital": 2, "pay": 1},
    category_floors={"merger": 1, "world": 1},
    promotion="for |pour",
    strategic="thanea|eaux",
    technical="ble|ment",
    source_weights={"src1": 5, "src2": 4, "src3": 3},
    topics={"Deals": "purchase", "sign up": "signup", "errors": "error", "views": "view", "clicks": "click"},
    aggregations=("view",),
    default_topic="click",
    countries={"en": ("the", "and", "of"), "fr": ("les", "que", "une"), "de": ("der", "und", "ver"), "es": ("los", "para", "ción")},
    urgency=(R.Rule("alert", "!!"), R.Rule("watch", "ndble|erreth"), R.Rule("note", "thon")),
)
#: Issues that run over days, whatever the category of an item.
ISSUES = (R.Rule("outage", "thble|enment"), R.Rule("court", "eaulle|tione"), R.Rule("strike", "erver|versch"))
STOP, GENERIC = list(RULES.stop), list(RULES.generic)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as items: one each seven minutes of 2024. The title is the first sentence of the first line, the body the whole text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        urls.item_key(F.col("source"), F.col("doc_id").cast("string")).alias("key"),
        "source",
        "lang",
        F.split(F.split("text", "\n")[0], r"\. ")[0].alias("title"),
        F.col("text").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 420).alias("ts"),
    )


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with words, names, action and time bucket, as the pair rules read them."""
    rows = items(spark, sf_dir)
    words = T.tokens(F.col("title"), STOP)
    kinds = F.array(*map(F.lit, ("deal", "partnership", "regulation", "market", "product")))
    rows = rows.withColumns({"tokens": words, "ents": R.mentions(F.col("title"), RULES), "action": F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")), "bucket": F.floor(F.unix_timestamp("ts") / 259200)})
    material = R.is_material(F.col("title"), None, RULES)
    return rows.withColumns({"material": material, "telling": T.distinctive(F.col("tokens"), GENERIC), "coverage": R.coverage(F.col("title"), F.size("tokens"), F.size("ents"), material, RULES).cast("int")})


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a publish log."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("key"), F.col("ts"), F.col("user_id").alias("cluster"), "event_type", R.action_group(F.col("event_type"), RULES).alias("action"), F.least(F.lit(100), F.floor("value")).cast("int").alias("score"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def fits(column: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({column}, ''), {_q('(?i)' + pattern)})"


#: The same in SQL.
NORM = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '[^\p{L}\p{N}_ ]+', ' ', 'g'), '\s+', ' ', 'g')))"
MENTIONS = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(title), {_q(a.lower())})' for a in (n, *al))} THEN {_q(n)} END" for names in RULES.aliases.values() for n, al in names.items()) + "], lambda x: x IS NOT NULL)"
MATERIAL = "(" + " OR ".join(f"contains(lower(title), {_q(m)})" for m in RULES.material) + ")"
ITEMS = """items AS (SELECT doc_id, sha256(source || '::' || doc_id::VARCHAR) AS key, source, lang, split_part(split_part(text, chr(10), 1), '. ', 1) AS title,
    text AS body, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7) AS ts, 1704067200 + doc_id * 420 AS epoch FROM documents)"""
DESCRIBED = rf"""{ITEMS}, worded AS (SELECT *, list_filter(list_distinct(list_filter(string_split({NORM}, ' '), lambda x: length(x) > 1)), lambda x: NOT list_contains({_list(STOP)}, x)) AS tokens,
    {MENTIONS} AS ents, (['deal', 'partnership', 'regulation', 'market', 'product'])[(doc_id % 5 + 1)::INT] AS action, epoch // 259200 AS bucket, {MATERIAL} AS material FROM items),
    described AS (SELECT *, list_filter(tokens, lambda x: NOT list_contains({_list(GENERIC)}, x) AND NOT regexp_matches(x, '^[0-9][0-9,.]*\p{{L}}{{0,2}}%?$') AND length(x) >= 2) AS telling,
    (CASE WHEN material THEN 20 ELSE 0 END + len(ents) * 6 + 5 * len(regexp_extract_all(lower(title), {_q(RULES.scope)})) + least(len(tokens), 12))::INT AS coverage FROM worded)"""
LOG = f"""log AS (SELECT event_id AS key, ts, user_id AS cluster, event_type, CASE event_type {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in RULES.actions.items())} ELSE 'other' END AS action,
    least(100, floor(value))::INT AS score, json_extract_string(props, '$.k')::INT AS k FROM events)"""
JACCARD = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def jaccard(a: str, b: str) -> str:
    return JACCARD.format(a=a, b=b)


def reason() -> str:
    parts = []
    for g in RULES.gates:
        test = fits("title", g.pattern) + (f" AND {fits('title', g.also)}" if g.also else "") + (f" AND NOT {fits('title', g.rescue)}" if g.rescue else "")
        parts.append(f"WHEN {test} THEN {_q(g.reason)}")
    return f"CASE {' '.join(parts)} END"


def score() -> str:
    spaced = "title || ' '"  # the score reads title and names, joined by a blank
    weights = [f"(CASE WHEN {fits(spaced, r.pattern)} THEN {float(r.weight)}::DOUBLE ELSE 0.0::DOUBLE END)" for r in RULES.scores]
    penalties = [f"(CASE WHEN {fits(spaced, r.pattern)} THEN {float(r.weight)}::DOUBLE ELSE 0.0::DOUBLE END)" for r in RULES.penalties]
    top = f"greatest({', '.join(weights)})"
    points = f"{top} + 0.2::DOUBLE * (({' + '.join(weights)}) - {top}) + {' + '.join(penalties)}"
    return f"CASE WHEN {fits(spaced, RULES.foreign)} AND NOT {fits(spaced, RULES.anchors)} AND len({axes()}) = 0 THEN 0 ELSE greatest(0, least(100, trunc({points})::INT)) END"


def axes() -> str:
    spaced = "title || ' '"
    named = [f"CASE WHEN {fits(spaced, r.pattern)}{' AND ' + fits(spaced, RULES.proper_names) if r.name == RULES.generic_axis else ''} THEN {_q(r.name)} END" for r in RULES.scores if r.name in RULES.axes]
    return f"list_filter([{', '.join(named)}], lambda x: x IS NOT NULL)"


def category() -> str:
    return "CASE " + " ".join(f"WHEN {fits('title', r.pattern)} THEN {_q(r.name)}" for r in sorted(RULES.scores, key=lambda r: -r.weight)) + " ELSE 'other' END"
