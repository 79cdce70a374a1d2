"""Queries of the scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import probability as prob
from ..functions import text as tx
from ..operators.ranks import quantiles
from .registry import Tables, query

NOW = "2024-01-03"
SQUEEZE = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'))"
DECODE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
TO_TEXT = SQUEEZE.format(DECODE.format("regexp_replace(regexp_replace({}, '<(?:script|style|aside)[^>]*>.*?</(?:script|style|aside)>', ' ', 'gs'), '<[^>]+>', ' ', 'g')"))


@query("f1_html_to_text", f"SELECT page_id, {TO_TEXT.format('html')} AS text FROM pages")
def f1(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", tx.html_to_text(F.col("html")).alias("text"))


BODY = "regexp_replace(regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's'), '<p[^>]*>\\s*<a [^>]*>[^<]*</a>\\s*</p>', ' ', 'gs')"


@query("f2_main_body", f"SELECT page_id, {TO_TEXT.format(BODY)} AS body FROM pages")
def f2(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", tx.main_body(F.col("html")).alias("body"))


@query("f3_paragraphs", f"WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<p>(.*?)</p>', 1, 's'), lambda x: {TO_TEXT.format('x')}), lambda x: length(x) >= 55)[1:3] AS p FROM pages) SELECT page_id, unnest(p) AS paragraph FROM p")
def f3(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", F.explode(tx.paragraphs(F.col("html"))).alias("paragraph"))


@query("f4_jsonld_article", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'src' || CAST(doc_id AS VARCHAR) END AS headline FROM documents")
def f4(t: Tables) -> DataFrame:
    block = lambda kind, name: F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit(kind).alias("@type"), name.alias("headline"))), F.lit("</script>"))
    name = F.concat(F.lit("src"), F.col("doc_id").cast("string"))
    html = F.concat(F.lit("<head>"), block("WebPage", F.lit("x")), F.when(F.col("doc_id") % 3 == 0, block("NewsArticle", name)).otherwise(""), F.lit("</head>"))
    return t["documents"].select("doc_id", F.get_json_object(tx.jsonld_article(html), "$.headline").alias("headline"))


@query("f5_canonical_url", r"SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&{2,}', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', '') END AS canonical FROM pages")
def f5(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", tx.canonical_url(F.col("url")).alias("canonical"))


@query("f6_host_matches", "SELECT page_id, h = 'example.com' OR ends_with(h, '.example.com') AS matches FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h FROM pages)")
def f6(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", tx.host_matches(tx.url_host(F.col("url")), F.lit("example.com")).alias("matches"))


@query("f7_unwrap_link", "SELECT page_id, url AS target FROM pages WHERE starts_with(url, 'https://')")
def f7(t: Tables) -> DataFrame:
    link = F.concat(F.lit("[see "), F.col("page_id").cast("string"), F.lit("]("), F.col("url"), F.lit(")"))
    return t["pages"].where(F.startswith("url", F.lit("https://"))).select("page_id", tx.unwrap_markdown_link(link).alias("target"))


@query("f8_content_hash", "SELECT doc_id, sha256(coalesce(text, '') || chr(31) || coalesce(lang, '')) AS hash, 'doc-' || substr(sha256(coalesce(source, '') || chr(31) || CAST(doc_id AS VARCHAR)), 1, 12) AS short FROM documents")
def f8(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", tx.content_hash(F.col("text"), F.col("lang")).alias("hash"), tx.short_id("doc", F.col("source"), F.col("doc_id")).alias("short"))


@query("f9_package_id", "SELECT category, sha256(array_to_string(list_sort(list(DISTINCT event_key)), chr(10))) AS package FROM v_signals GROUP BY ALL")
def f9(t: Tables) -> DataFrame:
    return t.signals.groupBy("category").agg(tx.package_id(F.collect_set("event_key")).alias("package"))


@query("f10_normalize_region", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN c_mktsegment || ' Cityscape' ELSE c_mktsegment END AS name FROM customer")
def f10(t: Tables) -> DataFrame:
    suffix = F.get(F.array(*map(F.lit, (" Province", " City 3", "_7", "", " Cityscape"))), (F.col("c_custkey") % 5).cast("int"))
    return t["customer"].select("c_custkey", tx.normalize_region(F.concat("c_mktsegment", suffix)).alias("name"))




def _told():
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    return F.when(k == 0, F.concat(F.lit("prices rise by "), user, F.lit(" yuan"))).when(k == 1, F.concat(F.lit("a cut of 5, lowered by "), user)).when(k == 2, "prices are unchanged").otherwise("no news")


@query("f11_signed_amount", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS DOUBLE) WHEN 1 THEN -CAST(user_id AS DOUBLE) WHEN 2 THEN CAST(0 AS DOUBLE) END AS amount FROM events")
def f11(t: Tables) -> DataFrame:
    return t["events"].select("event_id", (tx.signed_amount(_told()) + 0.0).alias("amount"))


@query("f12_effective_date", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN make_date(2025, month(ts), day(ts)) END AS effective FROM events")
def f12(t: Tables) -> DataFrame:
    day = F.to_date("ts")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("from "), day.cast("string"), F.lit(" on"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("from "), F.date_format(day, "MM-dd"), F.lit(" on"))).otherwise("soon")
    return t["events"].select("event_id", tx.effective_date(text, F.lit(2025)).alias("effective"))


@query("f13_weeks", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(weekofyear(o_orderdate) AS INT) AS iso_week FROM orders")
def f13(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t["orders"].select(day.alias("day"), cal.week_start(day).alias("monday"), cal.iso_week(day).alias("iso_week")).distinct()


@query("f14_available_at", "SELECT DISTINCT release_date, CAST(strftime(timezone('America/Chicago', CAST(release_date + 1 AS TIMESTAMP)), '%Y-%m-%d %H:%M') AS VARCHAR) AS available FROM v_pit")
def f14(t: Tables) -> DataFrame:
    return t.pit.select("release_date", F.date_format(cal.available_at(F.col("release_date"), "America/Chicago"), "yyyy-MM-dd HH:mm").alias("available")).distinct()


@query("f15_trading_date", """
WITH l AS (SELECT event_id, timezone('America/New_York', timezone('UTC', CAST(ts AS TIMESTAMP))) AS local FROM events), d AS (SELECT event_id, CAST(local AS DATE) - CASE WHEN hour(local) >= 18 THEN 0 ELSE 1 END AS d FROM l),
w AS (SELECT event_id, d - CASE isodow(d) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS trading_date FROM d)
SELECT event_id, CAST(trading_date AS DATE) AS trading_date, CAST(CASE WHEN trading_date IN (DATE '2024-01-01', DATE '2024-01-15') THEN trading_date - 3 ELSE trading_date END AS DATE) AS open_day FROM w
""")
def f15(t: Tables) -> DataFrame:
    days = t["events"].select("event_id", cal.expected_trading_date(F.col("ts").cast("timestamp")).alias("trading_date"))
    holidays = t.spark.sql("SELECT explode(array(date'2024-01-01', date'2024-01-15')) AS holiday")
    return cal.previous_open_day(days, "trading_date", holidays).select("event_id", "trading_date", "open_day")


@query("f16_release_at", "SELECT week, strftime(timezone('America/New_York', CASE WHEN week = DATE '1998-01-05' THEN TIMESTAMP '1998-01-12 12:00:00' ELSE CAST(week + 5 AS TIMESTAMP) + INTERVAL '10 hours 30 minutes' END), '%Y-%m-%d %H:%M') AS release FROM v_positions")
def f16(t: Tables) -> DataFrame:
    late = t.spark.sql("SELECT date'1998-01-05' AS period, timestamp'1998-01-12 12:00:00' AS release_local")
    return cal.release_at(t.positions.select("week"), "week", late).select("week", F.date_format("release_at", "yyyy-MM-dd HH:mm").alias("release"))


@query("f17_report_available", "SELECT week, week BETWEEN DATE '1997-03-01' AND DATE '1997-06-30' AS quarantined, CASE WHEN week NOT BETWEEN DATE '1997-03-01' AND DATE '1997-06-30' THEN CASE WHEN week = DATE '1998-01-05' THEN DATE '1998-02-01' ELSE week + 11 END END AS available_on FROM v_positions")
def f17(t: Tables) -> DataFrame:
    late = t.spark.sql("SELECT date'1998-01-05' AS report, date'1998-02-01' AS available_on_exception")
    held = t.spark.sql("SELECT date'1997-03-01' AS first_day, date'1997-06-30' AS last_day")
    return cal.report_available_at(t.positions.select("week"), "week", late, held)


@query("f18_half_up_step", "SELECT p_partkey, round(greatest(0.005, floor(p_retailprice / 1e5 / 0.005 + 0.5) * 0.005), 9) AS step FROM part")
def f18(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", F.round(prob.half_up_step(F.col("p_retailprice") / 1e5, 0.005, 0.005), 9).alias("step"))


@query("f19_js_round", "SELECT event_id, floor((value - 8) * 10 + 0.5) / 10 AS rounded FROM events")
def f19(t: Tables) -> DataFrame:
    return t["events"].select("event_id", prob.js_round(F.col("value") - 8, 1).alias("rounded"))


@query("f20_round_to_100", """
WITH s AS (SELECT row_id, model, round(p_down * 100, 9) AS a, round(p_flat * 100, 9) AS b, round(p_up * 100, 9) AS c FROM v_probs), f AS (SELECT *, floor(a) AS fa, floor(b) AS fb, floor(c) AS fc FROM s), l AS (SELECT *, 100 - fa - fb - fc AS n FROM f)
SELECT row_id, model, CAST(fa + CAST((CAST(b - fb > a - fa AS INT) + CAST(c - fc > a - fa AS INT)) < n AS INT) AS INT) AS down, CAST(fb + CAST((CAST(a - fa >= b - fb AS INT) + CAST(c - fc > b - fb AS INT)) < n AS INT) AS INT) AS flat,
CAST(fc + CAST((CAST(a - fa >= c - fc AS INT) + CAST(b - fb >= c - fc AS INT)) < n AS INT) AS INT) AS up FROM l
""")
def f20(t: Tables) -> DataFrame:
    d, f, u = prob.round_to_100(["p_down", "p_flat", "p_up"])
    return t.probs.select("row_id", "model", d.alias("down"), f.alias("flat"), u.alias("up"))


@query("f21_normalize", "WITH c AS (SELECT row_id, model, least(greatest(p_down, 0.1), 1) AS a, least(greatest(p_flat, 0.1), 1) AS b, least(greatest(p_up, 0.1), 1) AS c FROM v_probs) SELECT row_id, model, round(a / (a + b + c), 9) AS down, round(b / (a + b + c), 9) AS flat, round(c / (a + b + c), 9) AS up FROM c")
def f21(t: Tables) -> DataFrame:
    d, f, u = prob.normalize(["p_down", "p_flat", "p_up"], 0.1)
    return t.probs.select("row_id", "model", F.round(d, 9).alias("down"), F.round(f, 9).alias("flat"), F.round(u, 9).alias("up"))


@query("f22_hurdle", "SELECT row_id, model, round(p_down + p_up, 9) AS move, round(p_up / (p_down + p_up), 9) AS up_given_move, round(p_down, 9) AS down_again FROM v_probs")
def f22(t: Tables) -> DataFrame:
    move, up = prob.decompose("p_down", "p_flat", "p_up")
    again = prob.compose(move, up)[0]
    return t.probs.select("row_id", "model", F.round(move, 9).alias("move"), F.round(up, 9).alias("up_given_move"), F.round(again, 9).alias("down_again"))


@query("f23_mixture", "SELECT a.row_id, round(0.5 * a.p_down + 0.5 * b.p_down, 9) AS down, round(0.5 * a.p_up + 0.5 * b.p_up, 9) AS up FROM v_probs a JOIN v_probs b ON a.row_id = b.row_id AND a.model = 'm1' AND b.model = 'm2'")
def f23(t: Tables) -> DataFrame:
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    both = t.probs.groupBy("row_id").agg(*[pick(m, f"p_{c}").alias(f"{c}_{m}") for m in ("m1", "m2") for c in ("down", "up")])
    d, u = prob.mix(["down_m1", "up_m1"], ["down_m2", "up_m2"])
    return both.select("row_id", F.round(d, 9).alias("down"), F.round(u, 9).alias("up"))


@query("f24_cdf_to_classes", """
WITH q AS (SELECT series_id, quantile_cont(r, 0.1) AS a, quantile_cont(r, 0.5) AS b, quantile_cont(r, 0.9) AS c FROM (SELECT x.series_id, ln(x.value / y.value) AS r FROM v_weekly x JOIN v_weekly y ON x.series_id = y.series_id AND y.week = x.week - 7) GROUP BY ALL),
s AS (SELECT series_id, [a - (c - a), a, b, c, c + (c - a)] AS x, [0.0, 0.1, 0.5, 0.9, 1.0] AS y FROM q),
p AS (SELECT series_id, t, CASE WHEN t <= x[1] THEN 0 WHEN t <= x[2] THEN y[1] + (y[2] - y[1]) * (t - x[1]) / (x[2] - x[1]) WHEN t <= x[3] THEN y[2] + (y[3] - y[2]) * (t - x[2]) / (x[3] - x[2]) WHEN t <= x[4] THEN y[3] + (y[4] - y[3]) * (t - x[3]) / (x[4] - x[3]) WHEN t <= x[5] THEN y[4] + (y[5] - y[4]) * (t - x[4]) / (x[5] - x[4]) ELSE 1 END AS p FROM s, (VALUES (-0.02), (0.02)) v(t))
SELECT series_id, round(max(p) FILTER (t < 0), 6) AS down, round(1 - max(p) FILTER (t > 0), 6) AS up FROM p GROUP BY ALL
""")
def f24(t: Tables) -> DataFrame:
    from ..operators.asof import calendar_lag

    r = calendar_lag(t.written.weekly, ["series_id"], "week", ["value"], 1).where("value_lag1 is not null").withColumn("r", F.log(F.col("value") / F.col("value_lag1")))
    q = quantiles(r, ["series_id"], "r", [0.1, 0.5, 0.9]).select("series_id", F.array("q10", "q50", "q90").alias("q"))
    down, _, up = prob.cdf_to_classes(F.col("q"), [0.1, 0.5, 0.9], 0.02)
    return q.select("series_id", F.round(down, 6).alias("down"), F.round(up, 6).alias("up"))


@query("f25_wilson", "WITH c AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 10) AS k FROM events GROUP BY ALL), d AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM c) SELECT event_type, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS high FROM d")
def f25(t: Tables) -> DataFrame:
    c = t["events"].groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 10).alias("k"))
    low, high = prob.wilson("k", "n")
    return c.select("event_type", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("f26_argmax_class", "SELECT row_id, model, CASE WHEN p_down >= p_flat AND p_down >= p_up THEN 'DOWN' WHEN p_flat >= p_up THEN 'FLAT' ELSE 'UP' END AS class, CASE WHEN p_up > p_down THEN 'UP' ELSE 'DOWN' END AS direction FROM v_probs")
def f26(t: Tables) -> DataFrame:
    return t.probs.select("row_id", "model", prob.argmax_class("p_down", "p_flat", "p_up").alias("class"), prob.primary_direction("p_down", "p_up").alias("direction"))


@query("f27_integer_probs", "SELECT row_id, model, CAST(round(p_down * 100) + round(p_flat * 100) + round(p_up * 100) = 100 AS BOOLEAN) AS valid FROM v_probs")
def f27(t: Tables) -> DataFrame:
    whole = [F.round(F.col(p) * 100) for p in ("p_down", "p_flat", "p_up")]
    return t.probs.select("row_id", "model", prob.valid_percentages(whole).alias("valid"))


@query("f28_date_phrase", f"SELECT event_id, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d > 1 THEN CAST(d AS VARCHAR) || ' days ago' ELSE 'upcoming' END AS phrase FROM (SELECT event_id, DATE '{NOW}' - CAST(ts AS DATE) AS d FROM events)")
def f28(t: Tables) -> DataFrame:
    return t["events"].select("event_id", cal.date_phrase(F.to_date("ts"), F.lit(NOW).cast("date")).alias("phrase"))


@query("f29_truncate_keywords", "SELECT doc_id, substr(text, 1, 240) AS head, regexp_matches(text, '(?i)\\b(?:the|und|les)\\b') AS found FROM documents")
def f29(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", tx.truncate(F.col("text"), 240).alias("head"), tx.has_keyword(F.col("text"), ["the", "und", "les"]).alias("found"))


@query("f30_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def f30(t: Tables) -> DataFrame:
    return t["events"].select("event_id", tx.json_field(F.col("props"), "$.k").cast("int").alias("k"))
