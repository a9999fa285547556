"""Queries over tables: ledgers, joins, windows, clusters, editions, marts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import rules as R
from tidewire.functions import text as T
from tidewire.functions import times, urls
from tidewire.functions import published
from tidewire.operators import clusters, editions, ledgers, marts, pairs, routing
from tidewire.plans import sample as S
from tidewire.plans.scalars import ARTICLE_PLACE, ARTICLE_SQL, URL_KEY_SQL, URL_PARTS_SQL
from tidewire.sources import feeds
from tidewire.streaming import flows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Ledgers


@query(f"""WITH {S.ITEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY epoch, key) AS rn FROM items), k AS (SELECT *, lower(source) || substr(title, 1, 8) AS url_key FROM a WHERE rn = 1 OR title = '')
 SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY url_key ORDER BY epoch, key) AS rn FROM k) WHERE rn = 1""")
def dedupe_first_wins(spark, sf_dir):
    rows = S.items(spark, sf_dir).withColumn("url_key", F.concat(F.lower("source"), F.substring("title", 1, 8)))
    return ledgers.first_wins(rows, ["title", "url_key"], [F.col("ts"), F.col("key")]).select("doc_id")


@query(f"WITH {S.LOG} SELECT cluster, key, score FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ts DESC, key DESC) AS rn FROM log) WHERE rn = 1")
def latest_per_key(spark, sf_dir):
    return ledgers.latest_per_key(S.log(spark, sf_dir), ["cluster"], [F.col("ts").desc(), F.col("key").desc()]).select("cluster", "key", "score")


@query(f"WITH {S.ITEMS} SELECT doc_id FROM items WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND source NOT IN (SELECT source FROM items WHERE ts < TIMESTAMP '2024-01-01 00:20:00')")
def unseen_anti(spark, sf_dir):
    rows = S.items(spark, sf_dir)
    return ledgers.unseen(rows, {"doc_id": S.table(spark, sf_dir, "labels").where("quality = 1"), "source": rows.where("ts < TIMESTAMP '2024-01-01 00:20:00'")}).select("doc_id")


@query(f"""WITH {S.LOG}, l AS (SELECT cluster AS key, max(score) AS score FROM log WHERE action = 'deal' GROUP BY 1), n AS (SELECT cluster AS key, min(score) AS score FROM log WHERE action <> 'deal' GROUP BY 1)
 SELECT * FROM l UNION ALL SELECT * FROM n WHERE key NOT IN (SELECT key FROM l)""")
def merge_insert_ignore(spark, sf_dir):
    log = S.log(spark, sf_dir)
    local = log.where("action = 'deal'").groupBy(F.col("cluster").alias("key")).agg(F.max("score").alias("score"))
    remote = log.where("action != 'deal'").groupBy(F.col("cluster").alias("key")).agg(F.min("score").alias("score"))
    return ledgers.merged(local, remote, ["key"])


@query(f"""WITH {S.LOG}, l AS (SELECT key, CASE WHEN score > 20 THEN score END AS score, k FROM log), r AS (SELECT key, score AS rs FROM log WHERE k < 50) SELECT l.key, coalesce(score, rs) AS score, k FROM l LEFT JOIN r USING (key)""")
def merge_fill_null(spark, sf_dir):
    log = S.log(spark, sf_dir)
    local = log.select("key", F.when(F.col("score") > 20, F.col("score")).alias("score"), "k")
    return ledgers.filled(local, log.where("k < 50").select("key", "score"), "key")


@query(f"WITH {S.LOG} SELECT key, cluster FROM log WHERE NOT (cluster IN (SELECT cluster FROM log WHERE score > 95) AND cluster NOT IN (SELECT cluster FROM log WHERE action = 'deal' AND score > 80))")
def forget_unpublished(spark, sf_dir):
    log = S.log(spark, sf_dir)
    return ledgers.forget(log, log.where("score > 95"), "cluster", log.where("action = 'deal' AND score > 80")).select("key", "cluster")


@query(f"""WITH {S.LOG}, w AS (SELECT DISTINCT action AS scope, strftime(ts, '%Y-%m-%d %H') AS window_end FROM log), r AS (SELECT DISTINCT action AS scope, strftime(ts, '%Y-%m-%d %H') AS window_end FROM log WHERE score > 90) SELECT * FROM w EXCEPT SELECT * FROM r""")
def pending_runs(spark, sf_dir):
    log = S.log(spark, sf_dir).select(F.col("action").alias("scope"), F.date_format("ts", "yyyy-MM-dd HH").alias("window_end"), "score")
    return ledgers.pending_runs(log.select("scope", "window_end").distinct(), log.where("score > 90"))


@query(f"""WITH {S.LOG}, d AS (SELECT cluster % 10 AS edition, cluster AS draft, count(*) * 1000 + avg(score) + greatest(0, 1 - avg(coalesce(nullif(k, 0)::DOUBLE, 48)) / 48) AS quality, max(key) AS built FROM log WHERE score > 60 GROUP BY 1, 2)
 SELECT edition, draft AS keys FROM (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY quality DESC, draft) AS rn FROM d) WHERE rn = 1""")
def draft_champion(spark, sf_dir):
    log = S.log(spark, sf_dir).where("score > 60").withColumns({"edition": F.col("cluster") % 10, "fit": F.col("score"), "age_hours": F.nullif("k", F.lit(0)).cast("double")})
    drafts = ledgers.quality(log, ["edition", "cluster"]).select("edition", F.col("cluster").alias("keys"), "quality", F.timestamp_seconds("cluster").alias("built_at"))
    return ledgers.champions(drafts).select("edition", "keys")


@query(f"""WITH {S.LOG}, m AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts DESC) AS rn FROM log) SELECT key FROM m WHERE rn = 1 ORDER BY ts DESC LIMIT 3000""")
def rolling_history(spark, sf_dir):
    return ledgers.rolling(S.log(spark, sf_dir), F.date_trunc("minute", "ts"), 3000, F.col("ts")).select("key")


@query(f"WITH {S.LOG} SELECT l.key, coalesce(p.score, l.score) AS score FROM log l LEFT JOIN (SELECT key, score + 1 AS score FROM log WHERE action = 'market') p USING (key)")
def patched_columns(spark, sf_dir):
    log = S.log(spark, sf_dir).select("key", "score", "action")
    return ledgers.patched(log.drop("action"), log.where("action = 'market'").drop("action").withColumn("score", F.col("score") + 1), "key")


# Joins


@query(f"""WITH {S.DESCRIBED}, w AS (SELECT doc_id, unnest(tokens) AS t FROM described), a(alias, name) AS (VALUES {', '.join(f'({S._q(a)}, {S._q(n)})' for _, n, a in R.alias_entries(S.RULES))})
 SELECT name, count(DISTINCT doc_id) AS n FROM w JOIN (SELECT DISTINCT alias, name FROM a) ON t = alias GROUP BY 1""")
def alias_join(spark, sf_dir):
    words = S.described(spark, sf_dir).select("doc_id", F.explode("tokens").alias("t"))
    return words.withColumn("name", R.canonical(F.col("t"), S.RULES)).where("name IS NOT NULL").groupBy("name").agg(F.countDistinct("doc_id").alias("n"))


@query(f"""WITH {S.LOG} SELECT a.key, max(b.key) AS seen FROM log a LEFT JOIN log b ON a.cluster = b.cluster AND b.ts < a.ts AND floor(epoch(a.ts)) - floor(epoch(b.ts)) <= 10 * 86400 GROUP BY 1""")
def asof_last_cluster(spark, sf_dir):
    log = S.log(spark, sf_dir)
    return pairs.latest_before(log.select("key", "cluster", "ts"), log, "cluster", 10).select("key", F.col("seen.key").alias("seen"))


@query(f"""WITH {S.DESCRIBED}, p AS (SELECT a.doc_id AS x, b.doc_id AS y, {S.jaccard('a.tokens', 'b.tokens')} AS j FROM described a JOIN described b ON a.doc_id < b.doc_id AND list_has_any(a.tokens, b.tokens)) SELECT x AS a_id, y AS b_id, j AS jaccard FROM p WHERE j >= 0.62""")
def token_jaccard_pairs(spark, sf_dir):
    return pairs.jaccard_pairs(S.described(spark, sf_dir), 0.62, "doc_id")


_NAMES_OK = "NOT len(list_filter(list_distinct(list_concat(a.ents, b.ents)), lambda n: contains(n, x) OR contains(x, n))) > 0"
_TELL = f"len(list_filter(list_intersect(a.telling, b.telling), lambda x: {_NAMES_OK}))"


@query(f"""WITH {S.DESCRIBED}, p AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, {S.jaccard('a.tokens', 'b.tokens')} AS j, {_TELL} AS tell, list_has_any(a.ents, b.ents) AS shared FROM described a JOIN described b ON a.doc_id < b.doc_id AND a.action = b.action AND abs(a.bucket - b.bucket) <= 1 AND list_has_any(a.tokens, b.tokens))
 SELECT a_id, b_id FROM p WHERE j >= 0.62 OR (tell >= 2 AND j >= 0.25) OR (shared AND (j >= 0.25 OR tell >= 1))""")
def same_event_pairs(spark, sf_dir):
    rows = S.described(spark, sf_dir).select("doc_id", "tokens", "ents", "action", "bucket")
    hit = pairs.event_pairs(rows, S.GENERIC, F.col("a.doc_id") < F.col("b.doc_id"), "doc_id")
    return hit.select(F.col("a.doc_id").alias("a_id"), F.col("b.doc_id").alias("b_id"))


@query(f"""WITH {S.DESCRIBED}, p AS (SELECT a.doc_id AS loser, b.doc_id AS winner, b.coverage AS c, {S.jaccard('a.tokens', 'b.tokens')} AS j, {_TELL} AS tell, list_has_any(a.ents, b.ents) AS shared FROM described a JOIN described b ON a.coverage < b.coverage AND abs(a.epoch - b.epoch) <= 36 * 3600 AND a.action = b.action AND abs(a.bucket - b.bucket) <= 1 AND list_has_any(a.tokens, b.tokens))
 SELECT loser, winner FROM (SELECT *, row_number() OVER (PARTITION BY loser ORDER BY c DESC, winner) AS rn FROM p WHERE j >= 0.62 OR (tell >= 2 AND j >= 0.25) OR (shared AND (j >= 0.25 OR tell >= 1))) WHERE rn = 1""")
def dominated_pairs(spark, sf_dir):
    rows = S.described(spark, sf_dir).select("doc_id", "tokens", "ents", "action", "bucket", "coverage", "ts")
    return pairs.dominated(rows, S.GENERIC, 36, "doc_id")


@query(f"""WITH {S.DESCRIBED}, b AS (SELECT list_filter(list_distinct(list_filter(string_split({S.NORM}, ' '), lambda x: length(x) > 1)), lambda x: NOT list_contains({S._list(S.STOP)}, x)) AS tokens FROM (SELECT split_part(split_part(text, chr(10), 1), '. ', 1) AS title FROM benchmark)),
 hit AS (SELECT DISTINCT d.doc_id FROM described d, b WHERE {S.jaccard('d.tokens', 'b.tokens')} >= 0.30 OR len(list_filter(d.tokens, lambda x: len(list_filter(b.tokens, lambda y: starts_with(x, y) OR starts_with(y, x) OR (length(x) >= 3 AND length(y) >= 3 AND substr(x, 1, 3) = substr(y, 1, 3)))) > 0)) >= 3)
 SELECT doc_id FROM described WHERE doc_id NOT IN (SELECT doc_id FROM hit)""")
def shared_titles_anti(spark, sf_dir):
    rows = S.described(spark, sf_dir)
    titles = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), T.tokens(F.split(F.split("text", "\n")[0], r"\. ")[0], S.STOP).alias("tokens"))
    hit = pairs.shared_titles(rows.select("doc_id", "tokens"), titles, "doc_id")
    return rows.select("doc_id").join(hit, "doc_id", "left_anti")


@query(f"""WITH {S.DESCRIBED}, p AS (SELECT a.doc_id AS x, b.doc_id AS y, length(b.body) >= 400 AS free, len(list_intersect(a.tokens, b.tokens))::DOUBLE / least(len(a.tokens), len(b.tokens)) AS o FROM described a JOIN described b ON a.doc_id <> b.doc_id AND abs(a.epoch - b.epoch) <= 2 * 86400 AND list_has_any(a.tokens, b.tokens)),
 r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY o DESC, y) AS rn FROM p WHERE o >= 0.45) SELECT x AS doc_id, y AS alt FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY rn) AS k FROM r WHERE rn <= 8 AND free) WHERE k = 1""")
def best_alternative(spark, sf_dir):
    rows = S.described(spark, sf_dir).select("doc_id", "tokens", "ts", (F.length("body") >= 400).alias("free"))
    return pairs.alternatives(rows, rows, id_col="doc_id")


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS plain FROM pages), k AS (SELECT plain, min(page_id) AS page_id FROM p WHERE url = plain GROUP BY 1)
 SELECT p.page_id, CASE WHEN p.url <> p.plain THEN coalesce(k.plain, p.url) ELSE p.url END AS url FROM p LEFT JOIN k USING (plain)""")
def url_resolution(spark, sf_dir):
    """Addresses with a query or fragment, resolved where the plain address is known."""
    pages = S.table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^([^?#]*)", 1).alias("plain"))
    known = pages.where("url = plain").select("plain", F.col("plain").alias("target")).distinct()
    return pages.join(known, "plain", "left").select("page_id", F.when(F.col("url") != F.col("plain"), F.coalesce("target", "url")).otherwise(F.col("url")).alias("url"))


_STRICT = f"""p AS (SELECT a.doc_id AS x, list_intersect(a.ents, b.ents) AS shared, a.tokens AS ta, b.tokens AS tb, (a.action = b.action)::INT AS act, {S.jaccard('a.tokens', 'b.tokens')} AS j, {_TELL} > 0 AS tell FROM described a JOIN known b ON {{on}}),
 q AS (SELECT *, list_filter(ta, lambda x: {{beyond}}) AS ba, list_filter(tb, lambda x: {{beyond}}) AS bb, len(list_filter(list_intersect(ta, tb), lambda x: NOT list_contains({S._list(S.GENERIC)}, x) AND NOT regexp_matches(x, '^[0-9][0-9,.]*\\p{{{{L}}}}{{{{0,2}}}}%?$') AND length(x) >= 3 AND len(list_filter(shared, lambda n: starts_with(x, lower(n)))) = 0)) > 0 AS told FROM p),
 r AS (SELECT *, len(list_filter(ba, lambda x: length(x) >= 2 AND len(list_filter(bb, lambda y: length(y) >= 2 AND (starts_with(x, y) OR starts_with(y, x) OR (length(x) >= 3 AND length(y) >= 3 AND substr(x, 1, 3) = substr(y, 1, 3))))) > 0)) AS hits FROM q),
 hit AS (SELECT DISTINCT x FROM r WHERE CASE WHEN len(shared) > 0 THEN hits >= 2 AND least(len(shared), 2) + act + (j >= 0.25)::INT + least(hits, 2) + told::INT >= 3 ELSE j >= 0.62 OR tell END)
 SELECT doc_id FROM described WHERE doc_id NOT IN (SELECT x FROM hit)"""
_BEYOND = "NOT list_contains(list_transform(shared, lambda n: lower(n)), x) AND len(list_filter(shared, lambda n: length(n) >= 2 AND starts_with(x, lower(substr(n, 1, 2))))) = 0"


def _published(spark, sf_dir, condition):
    rows = S.described(spark, sf_dir).select("doc_id", "tokens", "ents", "action", "ts")
    return rows, rows.join(S.table(spark, sf_dir, "labels").where(condition).select("doc_id"), "doc_id", "left_semi")


@query(f"WITH {S.DESCRIBED}, known AS (SELECT * FROM described WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)), " + _STRICT.format(on="b.epoch < a.epoch AND a.epoch - b.epoch <= 48 * 3600", beyond=_BEYOND))
def unlike_recent_editions(spark, sf_dir):
    """Items whose story was in no edition of the two days before, by the strict rule."""
    rows, known = _published(spark, sf_dir, "quality = 0")
    return pairs.without_known(rows, known, lambda a, b: pairs.same_story(a, b, S.GENERIC, strict=True), ["tokens", "ents"], "doc_id", hours=48).select("doc_id")


@query(f"WITH {S.DESCRIBED}, known AS (SELECT * FROM described WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)), " + _STRICT.format(on="CAST(a.ts AS DATE) = CAST(b.ts AS DATE) + 1", beyond=_BEYOND))
def unlike_published_before(spark, sf_dir):
    """Items whose story wasn't published in the 24 hours before their window, a day, by the strict rule."""
    rows, known = _published(spark, sf_dir, "toxic = 1")
    rows, known = rows.withColumn("window", F.to_date("ts")), known.withColumn("window", F.date_add(F.to_date("ts"), 1))
    return pairs.without_known(rows, known, lambda a, b: pairs.same_story(a, b, S.GENERIC, strict=True), ["tokens", "ents"], "doc_id", equal=("window",)).select("doc_id")


@query(f"""WITH a AS (SELECT page_id, url, {ARTICLE_SQL} AS article FROM pages) SELECT page_id FROM a WHERE article = '' OR article NOT IN (SELECT article FROM a WHERE contains(url, 'utm_source'))""")
def unused_articles(spark, sf_dir):
    """Pages whose article was in no edition; those with a campaign's mark were."""
    article = lambda url: urls.article_key(url, [ARTICLE_PLACE])
    pages = S.table(spark, sf_dir, "pages").select("page_id", "url")
    used = pages.where(F.contains("url", F.lit("utm_source"))).select(article(F.col("url")).alias("article")).where("article != ''").distinct()
    plain = F.regexp_extract("url", r"^([^?#]*)", 1)
    return pairs.without_used(pages, used, [article(F.col("url")), article(plain)], "page_id").select("page_id")


# Clusters


@query()
def fold_by_event(spark, sf_dir):
    """Leaders of greedy folding by coverage: order-dependent, so without SQL; tests hold it against the plain loop."""
    rows = S.described(spark, sf_dir).select("doc_id", "tokens", "ents", "action", "coverage")
    blocks = pairs.story_blocks(rows, S.GENERIC, "doc_id").withColumns({"id": F.col("doc_id"), "rank": F.struct((-F.col("coverage")).alias("c"), F.col("doc_id").alias("d"))})
    # The rule isn't symmetric: of a pair, the row with the smaller id comes first.
    same = lambda a, b: F.when(a["doc_id"] < b["doc_id"], pairs.same_story(a, b, S.GENERIC)).otherwise(pairs.same_story(b, a, S.GENERIC))
    found = clusters.blocked_leaders(blocks, ["ents", "telling", "rare"], same, facts=["doc_id", "tokens", "ents", "action"])
    return found.select(F.col("id").alias("doc_id"), "leader")


@query()
def surviving_duplicates(spark, sf_dir):
    """The end of each chain of dominated duplicates; tests hold it against a plain loop."""
    return clusters.survivors(dominated_pairs(spark, sf_dir))


@query(f"""WITH {S.DESCRIBED} SELECT doc_id, array_to_string(list_sort(list_distinct(CASE WHEN len(ents) > 0 THEN ents ELSE list_sort(tokens)[1:2] END))[1:2], '+') || '|' || action || '|' || bucket AS fingerprint FROM described""")
def event_fingerprint(spark, sf_dir):
    return S.described(spark, sf_dir).select("doc_id", clusters.fingerprint(F.col("ents"), F.col("tokens"), F.col("action"), F.col("bucket")).alias("fingerprint"))


_STORY = "story AS (SELECT DISTINCT w FROM (SELECT unnest(telling) AS w FROM described JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT w FROM (SELECT unnest(telling) AS w FROM described JOIN labels USING (doc_id) WHERE quality = 0) GROUP BY w HAVING count(*) >= 3 AND length(w) >= 4))"


def _story(spark, sf_dir):
    rows = S.described(spark, sf_dir)
    labels = S.table(spark, sf_dir, "labels")
    return clusters.repeated_words(rows.join(labels.where("toxic = 1"), "doc_id"), rows.join(labels.where("quality = 0"), "doc_id"))


@query(f"WITH {S.DESCRIBED}, {_STORY} SELECT w AS word FROM story")
def theme_tokens_repeat3(spark, sf_dir):
    return _story(spark, sf_dir)


@query(f"""WITH {S.DESCRIBED}, {_STORY}, h AS (SELECT doc_id, count(*) AS n, count(*) FILTER (length(w) >= 4) AS long FROM (SELECT doc_id, unnest(telling) AS w FROM described WHERE NOT material) JOIN story USING (w) GROUP BY 1) SELECT doc_id FROM described WHERE doc_id NOT IN (SELECT doc_id FROM h WHERE long >= 1 OR n >= 2)""")
def story_blocked(spark, sf_dir):
    rows = S.described(spark, sf_dir).drop("key").withColumnRenamed("doc_id", "key")
    blocked = clusters.blocked_by_story(rows, _story(spark, sf_dir))
    return rows.join(blocked, "key", "left_anti").select(F.col("key").alias("doc_id"))


# Editions

_BRIEF = f"""b AS (SELECT *, strftime(ts, '%Y-%m-%d') AS edition, CASE action WHEN 'deal' THEN 1 WHEN 'regulation' THEN 2 ELSE 3 END AS tier FROM log),
 c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edition, cluster ORDER BY score DESC, key) AS rn FROM b) WHERE rn = 1)"""


def _brief_rows(spark, sf_dir):
    tier = F.when(F.col("action") == "deal", 1).when(F.col("action") == "regulation", 2).otherwise(3)
    return S.log(spark, sf_dir).withColumns({"edition": F.date_format("ts", "yyyy-MM-dd"), "tier": tier, "head": F.col("action"), "cluster": F.col("cluster").cast("string")})


@query(f"""WITH {S.LOG}, {_BRIEF}, h AS (SELECT *, row_number() OVER (PARTITION BY edition, action ORDER BY tier, score DESC, key) > 4 AS over FROM c)
 SELECT edition, key, place FROM (SELECT edition, key, row_number() OVER (PARTITION BY edition ORDER BY over::INT, tier, score DESC, key)::INT AS place FROM h) WHERE place <= 10""")
def brief_select(spark, sf_dir):
    return editions.brief(_brief_rows(spark, sf_dir), ["edition"]).select("edition", "key", "place")


@query(f"""WITH {S.LOG} SELECT action, key FROM (SELECT *, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), action ORDER BY score DESC, key) AS rn FROM log) WHERE rn <= CASE action WHEN 'deal' THEN 3 WHEN 'market' THEN 1 ELSE 2 END""")
def category_cap_topn(spark, sf_dir):
    rows = _brief_rows(spark, sf_dir)
    return editions.capped(rows, ["edition"], "action", {"deal": 3, "market": 1}, 2, [F.col("score").desc(), "key"]).select("action", "key")


@query(f"""WITH {S.LOG}, w AS (SELECT *, strftime(ts, '%Y-%m-%d') AS d, k < 10 AS incident FROM log WHERE score >= 20 OR k < 10), c AS (SELECT *, count(*) FILTER (incident) OVER o AS ni, count(*) FILTER (NOT incident) OVER o AS nu FROM w WINDOW o AS (PARTITION BY d ORDER BY ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT d AS edition, key FROM c WHERE CASE WHEN incident THEN ni <= 12 ELSE nu + ni <= 6 END""")
def key_issue_daily(spark, sf_dir):
    rows = _brief_rows(spark, sf_dir).withColumn("incident", F.col("k") < 10).where("score >= 20 OR incident")
    return editions.in_issue_order(rows, ["edition"]).select("edition", "key")


@query()
def edition_select(spark, sf_dir):
    """Daily editions under floors and caps: order-dependent, so without SQL; tests hold the stream of offers against the plain loop."""
    rows = S.described(spark, sf_dir)
    title = F.col("title")
    fit = R.score(title, F.lit(""), None, S.RULES) + R.risk_bonus(title, S.RULES)
    tier = R.tier(title, F.lit(None).cast("string"), F.array_join("ents", ","), F.lit(None).cast("string"), S.RULES, "trade", [], [])
    survivors = rows.select(
        F.to_date("ts").cast("string").alias("edition"), "key", fit.alias("fit"), (fit + R.tier_bonus(tier)).alias("rank_score"), R.primary_category(title, S.RULES).alias("category"), R.themes(title, F.lit(""), S.RULES).alias("themes"),
        F.coalesce(F.try_element_at("ents", F.lit(1)), F.lit("_")).alias("head"), R.is_promotion(title, S.RULES).alias("pr"), (F.length("body") >= 200).alias("readable"), "tokens", "ents", "action",
    )
    quotas = editions.Quotas(S.RULES.category_caps, S.RULES.theme_caps, S.RULES.category_floors, editions.alike(S.GENERIC))
    return editions.edition(survivors, ["edition"], quotas)


# Windows of time


@query(f"WITH {S.LOG} SELECT action, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, sum(score) AS score FROM log GROUP BY 1, 2")
def digest_hourly(spark, sf_dir):
    return S.log(spark, sf_dir).groupBy("action", F.date_format(F.window("ts", "1 hour").getField("start"), "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


@query(f"WITH {S.LOG} SELECT key FROM log WHERE ts > TIMESTAMP '2024-01-10 03:00:00' AND ts <= TIMESTAMP '2024-01-11 05:30:00'")
def brief_window(spark, sf_dir):
    at = lambda t: F.lit(t).cast("timestamp")
    return S.log(spark, sf_dir).where(times.in_window(F.col("ts"), at("2024-01-10 03:00:00"), at("2024-01-11 05:30:00"))).select("key")


@query(f"""WITH {S.LOG}, d AS (SELECT *, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM log), e AS (SELECT key, ts, unnest([day, day + 1]) AS edition FROM d)
 SELECT key, strftime(edition, '%Y-%m-%d') AS edition FROM e WHERE ts > edition::TIMESTAMP - INTERVAL 1 DAY + INTERVAL 410 MINUTE - INTERVAL 9 HOUR AND ts <= edition::TIMESTAMP + INTERVAL 6 HOUR - INTERVAL 9 HOUR""")
def edition_window(spark, sf_dir):
    day = F.to_date(F.from_utc_timestamp("ts", "Asia/Seoul"))
    rows = S.log(spark, sf_dir).select("key", "ts", F.explode(F.array(day, F.date_add(day, 1))).alias("edition"))
    since, until = times.edition_bounds(F.col("edition"))
    return rows.where(times.in_window(F.col("ts"), since, until)).select("key", F.col("edition").cast("string").alias("edition"))


# Marts


@query(f"WITH {S.LOG} SELECT day, judged, passed, sent FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS judged, count(*) FILTER (score >= 50) AS passed, count(*) FILTER (score >= 65) AS sent FROM log GROUP BY 1) ORDER BY day DESC LIMIT 30")
def daily_trend(spark, sf_dir):
    return marts.daily_trend(S.log(spark, sf_dir))


@query(f"WITH {S.LOG}, r AS (SELECT * FROM log WHERE score < 50 ORDER BY ts DESC, key DESC LIMIT 600) SELECT reason, n FROM (SELECT substr(action || ' ' || event_type, 1, 40) AS reason, count(*) AS n FROM r GROUP BY 1) ORDER BY n DESC, reason LIMIT 12")
def drop_reasons_top12(spark, sf_dir):
    rows = S.log(spark, sf_dir).where("score < 50").withColumn("reason", F.concat_ws(" ", "action", "event_type"))
    return marts.drop_reasons(rows)


@query(f"WITH {S.DESCRIBED} SELECT word, n FROM (SELECT unnest(telling) AS word, count(*) AS n FROM described GROUP BY 1) ORDER BY n DESC, word LIMIT 24")
def entity_top24(spark, sf_dir):
    return marts.frequencies(S.described(spark, sf_dir), "telling", "word", 24)


@query(f"WITH {S.LOG} SELECT strftime(ts, '%Y-%m-%d') AS edition, count(*) AS n, array_to_string(list_sort(list(DISTINCT action)), ',') AS topics, sum(key) AS keys FROM log WHERE score >= 65 GROUP BY 1")
def editions_mart(spark, sf_dir):
    return marts.editions(S.log(spark, sf_dir).where("score >= 65").withColumn("edition", F.date_format("ts", "yyyy-MM-dd"))).select("edition", "n", F.array_join("topics", ",").alias("topics"), "keys")


@query(f"WITH {S.LOG} SELECT count(*) AS judged, count(*) FILTER (score >= 65) AS sent, count(*) FILTER (score >= 85 AND action = 'deal') AS key_issues, count(DISTINCT cluster) AS clusters, floor(epoch(max(ts)))::BIGINT AS last FROM log")
def summary_kpis(spark, sf_dir):
    return marts.kpis(S.log(spark, sf_dir))


@query(f"WITH {S.LOG}, g AS (SELECT floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY cluster ORDER BY ts, key) AS gap, cluster FROM log) SELECT cluster, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS gap FROM g WHERE gap IS NOT NULL GROUP BY 1")
def gap_upper_median(spark, sf_dir):
    return marts.upper_median_gap(S.log(spark, sf_dir), "cluster")


@query("""SELECT s.source, coalesce(p.n, 0) AS expected, coalesce(g.n, 0) AS judged, coalesce(b.n, 0) AS hit FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1) p USING (source)
 LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE n_chars > 500 GROUP BY 1) g USING (source) LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND n_chars > 500 GROUP BY 1) b USING (source)""")
def eval_precision(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").join(S.table(spark, sf_dir, "labels"), "doc_id", "left")
    return marts.evaluation(docs.select("source", (F.col("quality") == 1).alias("expected"), (F.col("quality").isNotNull() & (F.col("n_chars") > 500)).alias("judged")), "source")


@query("""WITH a AS (SELECT source, count(*)::DOUBLE / (SELECT count(*) FROM documents) AS s FROM documents GROUP BY 1), b AS (SELECT source, count(*)::DOUBLE / (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS t FROM documents JOIN labels USING (doc_id) GROUP BY 1)
 SELECT round(sum(abs(coalesce(s, 0) - coalesce(t, 0))) * 100, 6) AS points FROM a FULL JOIN b USING (source)""")
def topic_deviation(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "source")
    return marts.deviation(docs, docs.join(S.table(spark, sf_dir, "labels"), "doc_id"), "source")


@query(f"""WITH {S.LOG}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS edition, key AS k, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY score DESC, key) - 1 AS pos FROM log)
 SELECT edition, pos::INT AS pos, l.key, l.score FROM d LEFT JOIN (SELECT key, score FROM log WHERE action <> 'deal') l ON l.key = d.k WHERE pos < 6""")
def draft_order(spark, sf_dir):
    """Each day's draft, in its order, with the attributes of the articles that are known (those of one action are not)."""
    log = S.log(spark, sf_dir).withColumn("edition", F.date_format("ts", "yyyy-MM-dd"))
    pos = F.row_number().over(Window.partitionBy("edition").orderBy(F.col("score").desc(), "key")) - 1
    draft = log.select("edition", F.col("key").alias("k"), pos.alias("pos")).where("pos < 6")
    return draft.join(log.where("action != 'deal'").select("key", "score"), F.col("k") == F.col("key"), "left").select("edition", "pos", "key", "score")


@query(f"""WITH {S.ITEMS}, t AS (SELECT doc_id, ts, CASE WHEN contains(source, 'wiki') THEN 2 WHEN contains(source, 'news') OR contains(source, 'gov') THEN 0 ELSE 1 END AS tier FROM items),
 r AS (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY tier, ts DESC NULLS LAST, doc_id) AS place FROM t) SELECT doc_id, tier, place <= 40 AS taken FROM r""")
def budget_queue(spark, sf_dir):
    rows = S.items(spark, sf_dir).select("doc_id", "ts", routing.priority(F.col("source"), ["news", "gov"], ["wiki"]).alias("tier"), F.to_date("ts").alias("day"))
    return routing.within_budget(rows, "day", 40, routing.queue_order(F.col("tier"), F.col("ts"), "doc_id")).select("doc_id", "tier", "taken")


@query(f"WITH {S.LOG} SELECT key, CASE WHEN action IN ('regulation', 'governance') THEN 30 ELSE 60 END AS least FROM log WHERE score >= CASE WHEN action IN ('regulation', 'governance') THEN 30 ELSE 60 END")
def over_importance_floor(spark, sf_dir):
    least = routing.importance_floor(F.col("action"), ["regulation", "governance"], 30, 60)
    return S.log(spark, sf_dir).withColumn("least", least).where("score >= least").select("key", "least")


@query(f"""WITH {S.LOG}, o AS (SELECT key, CASE WHEN k > 1 THEN ts END AS origin FROM log)
 SELECT key, coalesce(CAST(origin AS DATE) >= DATE '2024-01-11', TRUE) AS of_day, coalesce(origin >= TIMESTAMP '2024-01-10 21:50:00', TRUE) AS of_window FROM o""")
def origin_floors(spark, sf_dir):
    rows = S.log(spark, sf_dir).select("key", F.when(F.col("k") > 1, F.col("ts")).alias("origin"))
    of_day = times.not_before_day(F.col("origin"), F.lit("2024-01-11").cast("date"))
    return rows.select("key", of_day.alias("of_day"), times.not_before(F.col("origin"), F.lit("2024-01-10 21:50:00").cast("timestamp")).alias("of_window"))


@query(f"""WITH {S.LOG}, e AS (SELECT strftime(ts, '%Y-%m-%d') AS edition, * FROM log WHERE score >= 65)
 SELECT edition, key, row_number() OVER (PARTITION BY edition ORDER BY CASE action WHEN 'deal' THEN 1 WHEN 'market' THEN 2 ELSE 3 END, CASE WHEN k % 13 <> 0 THEN floor(epoch(ts)) ELSE 0 END, key)::INT AS place FROM e""")
def edition_items(spark, sf_dir):
    """Editions by topic and original time; some rows have no time, and come first of their topic."""
    rows = S.log(spark, sf_dir).where("score >= 65").withColumn("edition", F.date_format("ts", "yyyy-MM-dd")).withColumn("ts", F.when(F.col("k") % 13 != 0, F.col("ts")))
    return marts.edition_items(rows, ["deal", "market"]).select("edition", "key", "place")


@query(f"WITH {S.LOG} SELECT CASE WHEN score >= 65 THEN 'sent' WHEN k < 5 THEN 'dup' WHEN score >= 50 THEN 'passed' ELSE 'dropped' END AS facet, action, count(*) AS n FROM log GROUP BY 1, 2")
def verdict_facets(spark, sf_dir):
    return S.log(spark, sf_dir).groupBy(marts.facet(F.col("score") >= 65, F.col("k") < 5, F.col("score") >= 50).alias("facet"), "action").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.LOG}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (action = 'deal') AS caught FROM log GROUP BY 1) SELECT day, n, n - 300 AS over_baseline, round(caught::DOUBLE / n, 9) AS share FROM d")
def volume_vs_baseline(spark, sf_dir):
    return marts.volume(S.log(spark, sf_dir), 300, F.col("action") == "deal")


@query(f"WITH {S.LOG}, t(action) AS (VALUES ('deal'), ('market'), ('litigation')) SELECT t.action, coalesce(n, 0) AS n FROM t LEFT JOIN (SELECT action, count(*) AS n FROM log GROUP BY 1) USING (action)")
def topic_counts(spark, sf_dir):
    return marts.counts_with_zeros(S.log(spark, sf_dir), "action", ["deal", "market", "litigation"])


@query(f"WITH {S.LOG} SELECT key FROM log WHERE action = 'deal' AND score >= 65 ORDER BY score DESC, ts DESC, key LIMIT 12 OFFSET 24")
def page_of_articles(spark, sf_dir):
    return S.log(spark, sf_dir).where("action = 'deal' AND score >= 65").orderBy(F.col("score").desc(), F.col("ts").desc(), "key").offset(24).limit(12).select("key")


@query(f"""WITH {S.LOG} SELECT edition, string_agg(place || '. ' || action || ' ' || key, chr(10) ORDER BY place) AS text FROM (WITH {_BRIEF}, h AS (SELECT *, row_number() OVER (PARTITION BY edition, action ORDER BY tier, score DESC, key) > 4 AS over FROM c) SELECT edition, key, action, row_number() OVER (PARTITION BY edition ORDER BY over::INT, tier, score DESC, key)::INT AS place FROM h) WHERE place <= 10 GROUP BY 1""")
def bulletin(spark, sf_dir):
    picks = editions.brief(_brief_rows(spark, sf_dir), ["edition"])
    return marts.bulletin(picks.withColumn("line", F.concat_ws(" ", F.concat(F.col("place").cast("string"), F.lit(".")), "action", F.col("key").cast("string"))), "edition", "place")


# Sources, over payloads made from the tables


@query(f"WITH {S.ITEMS} SELECT source, trim(title) AS title, doc_id::VARCHAR AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM items) WHERE rn <= 15")
def feed_roundtrip(spark, sf_dir):
    """Each source's feed, of as many items as a feed delivers, written with character references and read again."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = S.items(spark, sf_dir).withColumn("place", place).where("place <= 15")
    id_ = F.col("doc_id").cast("string")
    title = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>https://example.com/"), id_, F.lit("</link><guid>"), id_, F.lit("</guid></item>"))
    payloads = rows.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", xml.alias("x")))), lambda s: s["x"]), "").alias("payload"))
    return feeds.feed_items(payloads).select("source", "title", "unique_id")


@query(r"""SELECT conv_id::VARCHAR || '-' || turn AS unique_id, CASE WHEN trim(split_part(text, chr(10), 1)) = '' THEN '(photo)' ELSE substr(trim(split_part(text, chr(10), 1)), 1, 120) END AS title FROM conversations WHERE length(text) >= 40""")
def channel_items(spark, sf_dir):
    rows = S.table(spark, sf_dir, "conversations")
    messages = rows.select(F.col("role").alias("channel"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("2024-01-02").cast("timestamp").alias("at"), "text", F.array().cast("array<string>").alias("photos"), F.array().cast("array<string>").alias("links"), F.lit(1).alias("page"))
    return feeds.channel_items(messages, F.lit("2024-01-01").cast("timestamp")).select("unique_id", "title")


# Candidates, runs and counts

_OPEN = "c AS (SELECT *, strftime(ts, '%Y-%m-%d') AS edition, CASE WHEN event_type = 'purchase' THEN strftime(ts, '%Y-%m-%d') END AS taken, CASE WHEN k % 7 > 0 THEN k / 100.0::DOUBLE END AS confidence FROM log), o AS (SELECT * FROM c WHERE taken IS NULL AND coalesce(confidence, 1) >= 0.5)"


def _judged(spark, sf_dir):
    """The log with an edition that took a row, and a confidence that isn't always known."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return S.log(spark, sf_dir).withColumns({"edition": day, "taken": F.when(F.col("event_type") == "purchase", day), "confidence": F.when(F.col("k") % 7 > 0, F.col("k") / 100.0)})


@query(f"WITH {S.LOG}, {_OPEN} SELECT key FROM o WHERE score >= 30 AND ts > TIMESTAMP '2024-01-05 06:50:00' AND ts <= TIMESTAMP '2024-01-12 06:00:00'")
def edition_candidates(spark, sf_dir):
    at = lambda t: F.lit(t).cast("timestamp")
    return ledgers.candidates(_judged(spark, sf_dir), "taken", 30, at("2024-01-05 06:50:00"), at("2024-01-12 06:00:00")).select("key")


@query(f"WITH {S.LOG}, {_OPEN}, d AS (SELECT edition, key, row_number() OVER (PARTITION BY edition ORDER BY score DESC, key)::INT AS pos FROM c) SELECT d.edition, d.pos, d.key, o.score FROM d JOIN o USING (key) WHERE pos <= 10")
def draft_restored(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    pos = F.row_number().over(Window.partitionBy("edition").orderBy(F.col("score").desc(), "key"))
    draft = rows.select("edition", "key", pos.alias("pos")).where("pos <= 10")
    return ledgers.restored(draft, rows.drop("edition"), "taken").select("edition", "pos", "key", "score")


@query(f"""WITH {S.LOG}, l AS (SELECT action AS scope, max(date_trunc('second', ts)) AS last_end FROM log GROUP BY 1)
 SELECT scope, epoch(last_end)::BIGINT AS last_end, greatest(epoch(last_end)::BIGINT, epoch(TIMESTAMP '2024-02-01')::BIGINT - 3 * 86400) AS since FROM l""")
def next_windows(spark, sf_dir):
    """Where the next window of each scope opens."""
    runs = S.log(spark, sf_dir).select(F.col("action").alias("scope"), F.date_trunc("second", "ts").alias("window_end"))
    since = times.window_start(F.col("last_end"), F.lit("2024-02-01").cast("timestamp"))
    return ledgers.last_ends(runs).select("scope", F.unix_timestamp("last_end").alias("last_end"), F.unix_timestamp(since).alias("since"))


@query(f"""WITH {S.LOG}, s AS (SELECT a.key, a.k < 20 AS material, max(b.key) AS update_of FROM log a LEFT JOIN log b ON a.cluster = b.cluster AND b.ts < a.ts AND floor(epoch(a.ts)) - floor(epoch(b.ts)) <= 10 * 86400 GROUP BY 1, 2)
 SELECT key, update_of FROM s WHERE update_of IS NULL OR coalesce(material, FALSE)""")
def update_notes(spark, sf_dir):
    """New events, and new facts of ones that were published."""
    log = S.log(spark, sf_dir)
    return routing.follow_ups(log.withColumn("material", F.col("k") < 20), log).select("key", "update_of")


@query(f"""WITH {S.ITEMS}, f AS (SELECT 'source' AS facet, source AS value FROM items UNION ALL SELECT 'lang', lang FROM items UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d') FROM items)
 SELECT facet, value, n FROM (SELECT facet, value, count(*) AS n, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value NULLS FIRST) AS rn FROM f GROUP BY 1, 2) WHERE rn <= 15""")
def top_counts(spark, sf_dir):
    rows = S.items(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return marts.counts_by(rows, ["source", "lang", "day"], 15)


@query(f"""WITH {S.ITEMS}, c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, {S.category()} AS value, count(*) AS n FROM items GROUP BY 1, 2)
 SELECT day, value, n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, value NULLS FIRST) AS rn FROM c) WHERE rn <= 8""")
def top_categories_daily(spark, sf_dir):
    rows = S.items(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), R.primary_category(F.col("title"), S.RULES).alias("category"))
    return marts.counts_by(rows, ["category"], 8, ["day"]).select("day", "value", "n")


@query(f"WITH {S.DESCRIBED} SELECT doc_id FROM described WHERE lang = 'en' AND list_contains(ents, 'Thanea') AND ts >= TIMESTAMP '2024-01-02' AND (contains(lower(title), 'the') OR contains(lower(body), 'the'))")
def articles_shown(spark, sf_dir):
    rows = S.described(spark, sf_dir)
    return marts.shown(rows, {"lang": "en"}, {"ents": "Thanea"}, F.lit("2024-01-02").cast("timestamp"), "The", ["title", "body"]).select("doc_id")


@query(f"""WITH u AS (SELECT url, {URL_KEY_SQL} AS url_key FROM (SELECT url, {URL_PARTS_SQL} AS qs FROM pages))
 SELECT DISTINCT 'empty' AS ledger, url_key FROM u UNION ALL SELECT DISTINCT 'filled', url_key FROM u WHERE contains(url, 'https')""")
def seen_urls_backfill(spark, sf_dir):
    """The URL ledger, filled once from what was published: an empty one is, one with rows stays as it is."""
    pages = S.table(spark, sf_dir, "pages").select("url")
    filled = ledgers.backfilled_urls(pages.where("false").select(F.col("url").alias("url_key")), pages.where(F.contains("url", F.lit("https"))))
    named = lambda df, name: df.select(F.lit(name).alias("ledger"), "url_key")
    return named(ledgers.backfilled_urls(filled.where("false"), pages), "empty").unionByName(named(ledgers.backfilled_urls(filled, pages), "filled"))


@query(f"""WITH u AS (SELECT page_id, url, {URL_KEY_SQL} AS url_key FROM (SELECT page_id, url, {URL_PARTS_SQL} AS qs FROM pages)), s AS (SELECT DISTINCT url_key FROM u WHERE contains(url, 'https'))
 SELECT 'url' AS ledger, url_key AS value FROM (SELECT url_key FROM s UNION SELECT url_key FROM u WHERE contains(url, '.html')) UNION ALL SELECT 'key', page_id::VARCHAR FROM u WHERE contains(url, '.html') OR contains(url, 'utm_source')""")
def curated_seen(spark, sf_dir):
    """Both ledgers after curated pages were put in, some of which stood in either of them before."""
    pages = S.table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url")
    urls_seen = ledgers.backfilled_urls(pages.where("false").select(F.col("url").alias("url_key")), pages.where(F.contains("url", F.lit("https"))))
    keys_seen = pages.where(F.contains("url", F.lit("utm_source"))).select("key")
    keys, by_url = ledgers.seen_with(pages.where(F.contains("url", F.lit(".html"))), keys_seen, urls_seen)
    return by_url.select(F.lit("url").alias("ledger"), F.col("url_key").alias("value")).unionByName(keys.select(F.lit("key").alias("ledger"), F.col("key").cast("string").alias("value")))


# Routing


@query(f"WITH {S.LOG}, v AS (SELECT *, coalesce(k < 50, FALSE) AS judged FROM log) SELECT key, CASE WHEN judged AND score > 40 THEN 'market' ELSE action END AS category, judged AND score > 40 AND action <> 'market' AS moved FROM v WHERE NOT (judged AND score < 10)")
def verdicts_applied(spark, sf_dir):
    log = S.log(spark, sf_dir).select("key", F.col("action").alias("category"), "k", "score")
    verdicts = log.where("k < 50").select("key", (F.col("score") >= 10).alias("relevant"), F.when(F.col("score") > 40, "market").alias("category"))
    return routing.apply_verdicts(log.drop("k", "score"), verdicts)


@query(f"WITH {S.LOG}, h AS (SELECT * FROM log WHERE score >= 65) SELECT a.key FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.cluster = a.cluster AND floor(epoch(a.ts)) - floor(epoch(b.ts)) BETWEEN 1 AND 86400)")
def once_a_day(spark, sf_dir):
    high = S.log(spark, sf_dir).where("score >= 65")
    return routing.once_a_day(high, high).select("key")


@query(f"WITH {S.LOG} SELECT cluster, key FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY k DESC, score DESC, key) AS rn FROM log WHERE score > 10) WHERE rn = 1")
def readable_member(spark, sf_dir):
    rows = S.log(spark, sf_dir).withColumns({"coverage": F.col("k"), "readable": F.col("score") > 10})
    return routing.first_readable(rows, "cluster").select("cluster", "key")


@query(r"""WITH r AS (SELECT doc_id, source, lang, length(text) % 7 AS k FROM documents)
 SELECT doc_id, CASE k WHEN 0 THEN 'Daily ' || lang WHEN 1 THEN source WHEN 2 THEN source WHEN 3 THEN source || ' (' || lang || ' edition)' WHEN 4 THEN source WHEN 5 THEN lang || ' (' || source || '.com)' ELSE '' END AS label FROM r""")
def source_labels(spark, sf_dir):
    """Names as sources send them: wrapped, with a domain or a region in brackets, with a note that stays, with a tail word, with another name in brackets, blank."""
    source, lang = F.col("source"), F.col("lang")
    forms = [
        F.concat(F.lit("feed:x(Daily "), lang, F.lit(" (US))")), F.concat(F.initcap(source), F.lit(" ("), source, F.lit(".com)")), F.concat(source, F.lit(" (US) ")), F.concat(source, F.lit(" ("), lang, F.lit(" edition)")),
        F.concat(F.lit("  "), source, F.lit(" policy")), F.concat(lang, F.lit(" ("), source, F.lit(".com)")), F.lit("  "),
    ]
    raw = F.element_at(F.array(*forms), (F.length("text") % 7 + 1).cast("int"))
    label = published.source_label(raw, r"^feed:[^(]*\((.+)\)$", ["US"], ["policy"])
    return S.table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") % 7 == 1, F.lower(label)).otherwise(label).alias("label"))


@query(f"""WITH {S.ITEMS} SELECT doc_id, CASE WHEN regexp_matches(trim(title), '^(The|Les)') THEN 'rules' WHEN lang = 'en' AND NOT {S.fits("split_part(trim(title), ',', 1)", 'the')} THEN source ELSE lang END AS topic FROM items""")
def corrected_topics(spark, sf_dir):
    topic = routing.corrected_topic(F.col("lang"), F.array("lang", "source"), F.col("title"), "en", "the", "other", "The|Les", "rules")
    return S.items(spark, sf_dir).select("doc_id", topic.alias("topic"))


@query(f"""WITH {S.LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, action, CASE WHEN score < 50 THEN 'dropped' WHEN score < 65 THEN 'stored' ELSE 'posted' END AS disposition, count(*) AS n FROM log GROUP BY ROLLUP (1, 2, 3)""")
def stage_rollup(spark, sf_dir):
    """Counters by day, topic and disposition with all subtotals."""
    from tidewire.functions.judgments import disposition

    rows = S.log(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "action", disposition(F.col("score")).alias("disposition"))
    return rows.rollup("day", "action", "disposition").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.ITEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY epoch, key) AS rn FROM items), k AS (SELECT *, {S.score()} AS score, {S.category()} AS category FROM a WHERE (rn = 1 OR title = '') AND {S.reason()} IS NULL),
 c AS (SELECT *, row_number() OVER (PARTITION BY source, category ORDER BY score DESC, key) AS n FROM k) SELECT source, key, place FROM (SELECT source, key, row_number() OVER (PARTITION BY source ORDER BY score DESC, key)::INT AS place FROM c
 WHERE n <= CASE category WHEN 'trade' THEN 3 WHEN 'merger' THEN 3 ELSE 2 END) WHERE place <= 10""")
def curated_top(spark, sf_dir):
    """Items, first of each title, through the gates, scored, capped by category, the ten best of a source."""
    title = F.col("title")
    rows = ledgers.first_wins(S.items(spark, sf_dir), ["title"], [F.col("ts"), F.col("key")]).where(R.reject_reason(title, S.RULES).isNull())
    scored = rows.select("source", "key", R.score(title, F.lit(""), None, S.RULES).alias("score"), R.primary_category(title, S.RULES).alias("category"))
    kept = editions.capped(scored, ["source"], "category", S.RULES.category_caps, 2, [F.col("score").desc(), "key"])
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("score").desc(), "key"))
    return kept.select("source", "key", place.alias("place")).where("place <= 10")


@query("SELECT event_type, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H') AS window_end, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_hourly(spark, sf_dir):
    """Whole hours by type, read as a stream and written by micro-batches."""
    schema = S.table(spark, sf_dir, "events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/events.parquet*")
    out = clusters.stage_path(spark)
    counted = flows.hourly(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "ts")

    def each(df, number):
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    # Only windows that changed are written, so the watermark lets go of old ones; the last batch of a window holds its count.
    counted.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("event_type", "window_end").agg(F.max_by("n", "batch").alias("n"))
    return last.select("event_type", F.date_format("window_end", "yyyy-MM-dd HH").alias("window_end"), "n")
