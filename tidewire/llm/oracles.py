"""DuckDB SQL of the operators that SQL can express on whole tables.

The others rest on hashes, tokenizers, models or draws that DuckDB lacks; tests hold them against brute force.
"""

SQL = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93 AND NOT isnan(list_cosine_similarity(a.x, b.x))),
r(v, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.c)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN (SELECT v AS vec_id, min(c) AS c FROM r GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1) USING (vec_id)""",
    "op9_repeated_passages": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY sha256(array_to_string(ws[s:s + 19], ' ')) ORDER BY doc_id, s) > 1 AS late FROM s),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE late)),
kept AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS text, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) u
         ANTI JOIN gone g ON g.doc_id = u.doc_id AND g.i = u.i GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op5_url_reputation": r"""
WITH u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
marked AS (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
texts AS (SELECT regexp_replace(text, '[\s\x{A0}]+', '', 'g') AS t, max(bad) AS bad FROM documents JOIN marked USING (doc_id) WHERE text IS NOT NULL AND regexp_replace(text, '[\s\x{A0}]+', '', 'g') != '' GROUP BY 1),
read AS (SELECT host, regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(html, '(?is)<main\b[^>]*>(.*?)</main>', 1), ''), regexp_extract(html, '(?is)<body\b[^>]*>(.*?)</body>', 1)),
  '(?is)<h1\b[^>]*>.*?</h1>', '', 'g'), '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\s\x{A0}]+', '', 'g') AS t FROM u WHERE html IS NOT NULL),
h0 AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM read JOIN texts USING (t) GROUP BY 1),
two AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS d2 FROM h0),
h AS (SELECT host, n, bad, CASE WHEN regexp_matches(d2, '^(ac|co|com|edu|go|gov|mil|ne|net|nom|or|org)\.[a-z][a-z]$') THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE d2 END AS domain,
  CASE WHEN regexp_matches(d2, '^(ac|co|com|edu|go|gov|mil|ne|net|nom|or|org)\.[a-z][a-z]$') THEN d2 ELSE string_split(host, '.')[-1] END AS suffix FROM two),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
t AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS m, 0.0 AS v FROM s),
s1 AS (SELECT s.*, t.m AS pm, t.v AS pv FROM s, t),
s2 AS (SELECT *, (SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n * (n - 1) * pm * (1 - pm)) > 0 THEN sum((bad - n * pm) * (bad - n * pm) - n * pm * (1 - pm)) / sum(n * (n - 1) * pm * (1 - pm)) ELSE 0 END, 1.0 / 1001), 1.0::DOUBLE / 1001), 1.0::DOUBLE / 3) - 1 FROM s1) AS k FROM s1),
s3 AS (SELECT suffix, (bad + k * pm) / (n + k) AS m, n, k, pv FROM s2), s4 AS (SELECT suffix, m, m * (1 - m) / (n + k + 1) + pow(k / (n + k), 2) * pv AS v FROM s3),
d1 AS (SELECT d.*, s4.m AS pm, s4.v AS pv FROM d JOIN s4 USING (suffix)),
d2 AS (SELECT *, (SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n * (n - 1) * pm * (1 - pm)) > 0 THEN sum((bad - n * pm) * (bad - n * pm) - n * pm * (1 - pm)) / sum(n * (n - 1) * pm * (1 - pm)) ELSE 0 END, 1.0 / 1001), 1.0::DOUBLE / 1001), 1.0::DOUBLE / 3) - 1 FROM d1) AS k FROM d1),
d3 AS (SELECT domain, (bad + k * pm) / (n + k) AS m, n, k, pv FROM d2), d4 AS (SELECT domain, m, m * (1 - m) / (n + k + 1) + pow(k / (n + k), 2) * pv AS v FROM d3),
h1 AS (SELECT h.*, d4.m AS pm, d4.v AS pv FROM h JOIN d4 USING (domain)),
h2 AS (SELECT *, (SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n * (n - 1) * pm * (1 - pm)) > 0 THEN sum((bad - n * pm) * (bad - n * pm) - n * pm * (1 - pm)) / sum(n * (n - 1) * pm * (1 - pm)) ELSE 0 END, 1.0 / 1001), 1.0::DOUBLE / 1001), 1.0::DOUBLE / 3) - 1 FROM h1) AS k FROM h1),
h3 AS (SELECT host, (bad + k * pm) / (n + k) AS m, n, k, pv FROM h2),
bad AS (SELECT host, m, m - 1.645 * sqrt(m * (1 - m) / (n + k + 1) + pow(k / (n + k), 2) * pv) AS low, (SELECT t.m FROM t) AS base FROM h3),
ruled AS (SELECT page_id, host, path, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, ruled.host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > base THEN 'block' ELSE 'allow' END AS verdict, round(m, 6) AS bad_mean, round(low, 6) AS bad_low
FROM ruled LEFT JOIN bad ON bad.host = ruled.host""",
    "op13_filter_audit": r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS fails FROM w LEFT JOIN m USING (doc_id)),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o(filter_order, mask) AS (SELECT '', 0 UNION ALL SELECT filter_order || x, mask + bit FROM o, letters WHERE mask & bit = 0),
s AS (SELECT filter_order, step::INT AS step, bit, (SELECT sum(l.bit) FROM letters l WHERE strpos(filter_order, l.x) < step)::INT AS before
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE mask = 31) JOIN letters ON x = substr(filter_order, step, 1)),
c AS (SELECT part, filter_order, step, bit, sum(n) FILTER (fails & (coalesce(before, 0) | bit) = 0) AS kept, sum(n) FILTER (fails & bit > 0 AND fails & coalesce(before, 0) = 0) AS removed,
      sum(n) FILTER (fails & bit > 0 AND fails & coalesce(before, 0) > 0) AS redundant, sum(n) FILTER (fails = bit) AS unique_fails,
      sum(good) FILTER (fails & bit > 0 AND fails & coalesce(before, 0) = 0) AS good_lost, sum(toxic) FILTER (fails & bit > 0 AND fails & coalesce(before, 0) = 0) AS toxic_lost FROM h, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM c""",
    "op11_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
cut AS (SELECT c.*, u.j, array_to_string(ws[1:u.j], ' ') AS lp, array_to_string(ws[u.j + 1:k], ' ') AS rp FROM c, (SELECT unnest([1, 2]) AS j) u WHERE u.j < k),
s AS (SELECT cut.lang, cut.k, cut.phrase, cut.a, cut.j, l.f AS l, r.f AS r, ((1000000::HUGEINT * cut.a * cut.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cut JOIN g l ON l.lang = cut.lang AND l.phrase = cut.lp AND l.k = cut.j JOIN g r ON r.lang = cut.lang AND r.phrase = cut.rp AND r.k = cut.k - cut.j),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
x AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY 1, 2),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN x ON x.lang = m.lang AND x.phrase = m.phrase AND m.k = 2 WHERE x.most IS NULL OR 100 * x.most < 50 * m.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
}
