import datetime as dt

from pyspark.sql import functions as F

from tidewire.functions import judgments as J
from tidewire.functions import rules as R
from tidewire.functions import text as T
from tidewire.functions import times, urls

DEALS = R.RuleSet(
    gates=(R.Gate("sports", "야구|축구"), R.Gate("market", r"(코스피|코스닥).{0,20}(마감|상승)", rescue="인수|합병"), R.Gate("coin", "비트코인", also="시세|급등", rescue="인수")),
    scores=(R.Rule("deal", "인수|합병|매각", 26), R.Rule("rule", "규제|당국", 11), R.Rule("abroad", "해외|미국", 15), R.Rule("ai", T.acronym("AI"), 13)),
    penalties=(R.Rule("hiring", "채용", -40),),
    aliases={"group": {"Hanwha Life": ("한화생명", "HANWHA LIFE")}, "rival": {"Samsung Life": ("삼성생명",)}},
    actions={"acquisition": "deal", "merger": "deal", "regulation": "regulation", "market": "market"},
    material=("확정", "승인"), ambiguous=("승인",), incident="해킹|유출", scope="전반", foreign="해외|미국", anchors="한화|인수",
    source_weights={"Daily": 5, "Press": 4}, topics={"M&A": "ma_governance", "Digital Asset": "digital_asset", "Key Issue": "key_issue"}, aggregations=("key_issue",), default_topic="other",
    countries={"us": ("미국", "연준"), "kr": ("한국", "금융위")},
)


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column.alias("c")).collect()]


def test_urls(spark):
    urls_in = ["HTTPS://www.Example.com:8080/a/b/?utm_source=x&id=3&b&fbclid=9#top", "http://example.com", "example", None, "", "https://u:p@m.site.org/x?a=%20b&a=2"]
    assert values(spark, urls_in, urls.normalize_url(F.col("x"))) == ["example.com/a/b?id=3&b=", "example.com/", "example", "", "", "m.site.org/x?a=%20b&a=2"]
    keys = ["https://www.a.com/news/articleView.html?idxno=123", "https://m.b.com/article/77", "https://news.google.com/articles/55", "https://c.com/about", "https://v.d.net/v/20260101"]
    assert values(spark, keys, urls.article_key(F.col("x"))) == ["a.com#123", "b.com#77", "", "", "v.d.net#20260101"]
    assert values(spark, ["https://www.x.com/1"], urls.host_label(F.col("x"))) == ["x.com"]


def test_titles(spark):
    title = "[단독] 한화생명, 애큐온 인수 확정 (종합)"
    assert values(spark, [title], T.normal_title(F.col("x"))) == ["한화생명 애큐온 인수 확정"]
    assert values(spark, ["ＡＢＣ ﬁne"], T.normal_title(F.col("x"), compatible=True)) == ["abc fine"]
    assert values(spark, [title], F.array_join(T.tokens(F.col("x"), ["확정"]), " ")) == ["한화생명 애큐온 인수"]
    words = lambda *w: F.array(*map(F.lit, w))
    one = spark.range(1)
    got = one.select(T.jaccard(words("a", "b"), words("b", "c")), T.overlap(words("a", "b"), words("b")), T.stem_hits(words("abcdef", "xy"), words("abczz", "xyz")), T.stem_hits(words("q"), words("q"))).first()
    assert tuple(got) == (1 / 3, 1.0, 2, 0)
    assert one.select(F.array_join(T.distinctive(words("deal", "5000억", "market", "akyon"), ["market"], words("deal corp")), ",")).first()[0] == "akyon"
    assert values(spark, ["Bank grows - Daily News", "a - b - Outlet", "no outlet"], T.split_outlet(F.col("x"))[1]) == ["Daily News", "Outlet", None]
    assert values(spark, ["Title - x | Outlet", "A :: b"], T.strip_tails(F.col("x"))) == ["Title", "A"]
    assert values(spark, ["<b>a</b><br>b &amp; c"], T.plain(F.col("x"))) == ["a\nb & c"]
    assert values(spark, ["abcdef", "abc"], T.cut(F.col("x"), 4)) == ["abc…", "abc"]
    assert values(spark, ["<i>한글</i> 漢字, (日本) 漢字"], F.array_join(T.foreign_parts(F.col("x")), ",")) == ["漢字"]


def test_rules(spark):
    titles = ["한화이글스 야구 우승", "코스피 2600선 마감", "코스피 상승, 삼성생명 인수", "비트코인 급등", "비트코인 은행 인수 시세", None]
    assert values(spark, titles, R.reject_reason(F.col("x"), DEALS)) == ["sports", "market", None, "coin", None, None]
    assert values(spark, ["한화생명", "hanwha life", "nobody"], R.canonical(F.col("x"), DEALS)) == ["Hanwha Life", "Hanwha Life", None]
    scores = values(spark, ["한화생명 인수, 당국 규제", "AI 채용", "AIR 채용", "미국 규제"], R.score(F.col("x"), F.lit(None), F.lit(80), DEALS))
    assert scores == [int(26 + 0.2 * 11 + 20), 0, 0, 0]
    assert values(spark, ["규제와 인수", "없음"], R.primary_category(F.col("x"), DEALS)) == ["deal", "other"]
    assert values(spark, ["승인", "확정", "검토"], R.is_material(F.col("x"), None, DEALS, strict=True)) == [False, True, False]
    assert values(spark, ["The Daily", "A Press", "x"], R.source_weight(F.col("x"), DEALS)) == [5, 4, 2]
    assert values(spark, ["m&a", "digital-asset", "Key issue", "zzz"], R.normal_topic(F.col("x"), DEALS)) == ["ma_governance", "digital_asset", "other", "other"]
    assert values(spark, ["미국 연준 한국", "미국 한국", "none"], R.country(F.col("x"), DEALS)) == ["us", None, None]
    tier = R.tier(F.col("x"), F.lit("x"), F.lit("한화생명"), F.lit("market"), DEALS, "deal", [], [])
    assert values(spark, ["인수", "기타"], tier) == [1, 4] and values(spark, ["1"], R.tier_bonus(F.lit(2))) == [15]


def test_judgments(spark):
    good = '{"relevant": true, "primary_topic": "a", "secondary_topics": ["a", "b", "agg", "c", "d", "e"], "strategic_score": 91.6, "main_entities": ["1","2","3","4","5","6"], "event_type": "odd", "title": "t", "summary": "s", "key_points": [], "why_it_matters": "w", "tags": ["#x", "y"], "confidence": 5}'
    rows = [f"```json\n{good}\n```", '{"relevant": false}', good.replace("91.6", "150"), good.replace('"w"', '" "'), good.replace('"primary_topic": "a"', '"primary_topic": "agg"'), "no json"]
    assert values(spark, rows, J.problem(J.read(F.col("x")), ["a", "b"])) == [None, None, "bad score", "no reason", "bad topic", "no judgment"]
    c = spark.createDataFrame([(good,)], "x string").select(J.cleaned(J.read(F.col("x")), ["deal"], ["agg"]).alias("c")).first().c
    assert (c.strategic_score, c.secondary_topics, len(c.main_entities), c.tags, c.event_type, c.confidence) == (92, ["b", "c", "d"], 5, ["x", "y"], "other", 1.0)
    assert values(spark, ["0", "0.4", None], J.confidence_or_full(F.col("x").cast("double"))) == [1.0, 0.4, 1.0]
    assert values(spark, ["49", "50", "65"], J.disposition(F.col("x").cast("int"))) == ["dropped", "stored", "posted"]


def test_times(spark):
    assert values(spark, ["1700000000", "1700000000000", "x"], F.unix_timestamp(times.epoch(F.col("x")))) == [1700000000, 1700000000, None]
    day = spark.createDataFrame([(dt.date(2026, 10, 6),)], "d date")
    since, until = day.select(*(F.unix_timestamp(c) for c in times.edition_bounds(F.col("d")))).first()
    assert until - since == 23 * 3600 + 600
    now = F.lit("2026-10-06 00:00:00").cast("timestamp")
    ts = F.to_timestamp("x")
    assert values(spark, ["2026-10-05 01:00:00", "2026-10-06 09:00:00", "2026-10-06 03:00:00"], F.unix_timestamp(times.repaired_clock(ts, now)) - F.unix_timestamp(now)) == [-82800, 0, None]
    assert values(spark, ["2026-10-04 00:00:00", "2026-10-05 12:00:00", None], times.is_stale(ts, now, 24)) == [True, False, False]
    assert values(spark, ["2026-10-06 12:00:00"], times.event_bucket(ts)) == [6910]
