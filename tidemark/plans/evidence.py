"""Queries of evidence handling (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.probability import valid_percentages
from ..operators import evidence as ev
from .functions import TO_TEXT
from .registry import Tables, query

TESTS = [(3, " the .* is "), (2, " und | les "), (1, " de ")]
DAYS = {"view": 1, "click": 3, "purchase": 7, "signup": 3, "error": 1}
NOW = "TIMESTAMP '2024-01-06'"


def now():
    return F.lit("2024-01-06").cast("timestamp_ntz")


@query("e1_priority", "SELECT doc_id, CASE WHEN regexp_matches(h, ' the .* is ') THEN 3 WHEN regexp_matches(h, ' und | les ') THEN 2 WHEN regexp_matches(h, ' de ') THEN 1 ELSE 0 END AS priority FROM (SELECT doc_id, string_split(text, chr(10))[1] AS h FROM documents)")
def e1(t: Tables) -> DataFrame:
    # documents have no headline; their whole first line stands for it
    return t["documents"].select("doc_id", ev.priority(F.get(F.split("text", "\n"), F.lit(0)), TESTS).alias("priority"))


PARAS = "SELECT page_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS pos, unnest(p) AS text FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<p>(.*?)</p>', 1, 's'), lambda x: " + TO_TEXT.format("x") + ") AS p FROM pages)"


def paragraphs(t: Tables) -> DataFrame:
    found = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), tx.html_to_text)
    return t["pages"].select("page_id", F.posexplode(found).alias("pos", "text"))


@query("e2_event_rules", rf"WITH p AS ({PARAS}), h AS (SELECT page_id, pos, CASE WHEN regexp_matches(text, '\bthe\b') AND regexp_matches(text, '\bis\b') AND NOT regexp_matches(text, '\bwas\b') THEN 1 WHEN regexp_matches(text, '\bder\b|\bla\b') THEN 2 END AS o FROM p) SELECT page_id, CASE o WHEN 1 THEN 'ENGLISH_NOW' ELSE 'OTHER' END AS rule, pos AS paragraph FROM h WHERE o IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY o, pos) = 1")
def e2(t: Tables) -> DataFrame:
    rules = t.spark.sql(r"SELECT 1 AS rule_order, 'ENGLISH_NOW' AS rule, array(r'\bthe\b', r'\bis\b') AS required, array(r'\bwas\b') AS forbidden UNION ALL SELECT 2, 'OTHER', array(r'\bder\b|\bla\b'), array()")
    return ev.apply_rules(paragraphs(t), rules, "page_id", "pos", "text")


# pages have no publication time; the page number stands for hours before the fetch, of which those beyond 72 are too old
AGE = "page_id % 97"
_CODES = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{code}' END" for code, p in ev.GUARDS.items())
_WEEKDAY = f"CASE WHEN len(list_filter(regexp_extract_all(text, '(?i)\\bon ({'|'.join(ev.WEEKDAYS)})\\b', 1), lambda d: (dayofweek({NOW} - to_hours({AGE})) - list_position({list(ev.WEEKDAYS)}, lower(d)) + 1 + 7) % 7 > 2)) > 0 THEN 'OLD_WEEKDAY' END"


@query("e3_guards", f"SELECT page_id, pos, array_to_string(list_filter([{_CODES}, {_WEEKDAY}], lambda x: x IS NOT NULL), ',') AS guards FROM ({PARAS})")
def e3(t: Tables) -> DataFrame:
    published = now() - F.make_dt_interval(hours=(F.col("page_id") % 97).cast("int"))
    return paragraphs(t).select("page_id", "pos", F.array_join(ev.guards(F.col("text"), F.to_date(published)), ",").alias("guards"))


@query("e4_asset_key", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'ring|bolt') THEN 'fastener' ELSE regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS asset FROM part")
def e4(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", ev.asset_key(F.col("p_name"), {"ring|bolt": "fastener"}).alias("asset"))


RELEVANT = "(?i)the|der|les|que"


@query("e5_documents", rf"""
WITH m AS (SELECT page_id, {AGE} AS age, regexp_extract(url, '/([0-9]{{3,}})(?:[./?#]|$)', 1) AS article, regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's') AS markup FROM pages),
p AS (SELECT *, list_filter(list_transform(regexp_extract_all(markup, '<p[^>]*>(.*?)</p>', 1, 's'), lambda x: {TO_TEXT.format("x")}), lambda x: x <> '') AS paras FROM m),
b AS (SELECT *, array_to_string(paras, chr(10)) AS body, list_filter(paras, lambda x: length(x) >= 55 AND regexp_matches(x, '{RELEVANT}'))[1:3] AS relevant FROM p)
SELECT page_id, CASE WHEN article = '' THEN 'UNSUPPORTED_ARTICLE_URL' WHEN age > 72 THEN 'ARTICLE_PUBLICATION_TIME_UNVERIFIED' WHEN length(body) < 70 THEN 'ARTICLE_BODY_NOT_READ' WHEN len(relevant) = 0 THEN 'UNRELATED_ARTICLE' END AS reject,
  'doc-' || article AS document_id, sha256(body) AS content_hash, array_to_string(list_transform(relevant, lambda x, i: 's' || CAST(i AS VARCHAR) || '-' || substr(sha256(x), 1, 12)), ',') AS segment_ids FROM b
""")
def e5(t: Tables) -> DataFrame:
    age = F.make_dt_interval(hours=(F.col("page_id") % 97).cast("int"))
    pages = t["pages"].select("page_id", "url", "html", (now() - age).alias("published_at"), now().alias("fetched_at"))
    return ev.build_documents(pages, "page_id", RELEVANT).select("page_id", "reject", "document_id", "content_hash", F.array_join(F.transform("segments", lambda x: x["id"]), ",").alias("segment_ids"))


@query("e6_dedup_multi")
def e6(t: Tables) -> DataFrame:
    # as in the reference, a source and the hash of its whole text, and a source and the hash of all its segments (here lines)
    text = F.coalesce("text", F.lit(""))
    segments = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    key = lambda x: F.to_json(F.struct("source", F.sha2(x, 256).alias("hash")))
    docs = t["documents"].select("doc_id", key(text).alias("content"), key(F.to_json(segments)).alias("segments"))
    return ev.dedup_multi(docs, ["content", "segments"], ["doc_id"], "doc_id").select(F.col("id").alias("doc_id"))


@query("e7_dedup_signals", "SELECT event_key, measurement_key, min_by(id, {'p': published_at, 'i': id}) AS id, CAST(count(*) - 1 AS INT) AS verified_by FROM v_signals GROUP BY ALL")
def e7(t: Tables) -> DataFrame:
    return ev.dedup_signals(t.signals, ["event_key", "measurement_key"], [F.col("published_at"), F.col("id")], "id")


@query("e8_dedup_url", "SELECT coalesce(nullif(regexp_extract(url, '/([0-9]{3,})(?:[./?#]|$)', 1), ''), url) AS article, min(page_id) AS page_id FROM pages GROUP BY ALL")
def e8(t: Tables) -> DataFrame:
    return ev.dedup_url(t["pages"].select("page_id", "url"), "url", "page_id")


EXPIRES = "published_at + to_days(CASE category WHEN 'purchase' THEN 7 WHEN 'click' THEN 3 WHEN 'signup' THEN 3 ELSE 1 END)"


@query("e9_expiry", f"SELECT id, {EXPIRES} AS expires_at, {EXPIRES} < {NOW} AS expired FROM v_signals")
def e9(t: Tables) -> DataFrame:
    e = ev.expiry(F.col("category"), F.col("published_at"), DAYS)
    return t.signals.select("id", e.alias("expires_at"), (e < now()).alias("expired"))


#: Categories that the types of events stand for.
_RULED = "CASE category WHEN 'view' THEN 'MARKET' WHEN 'click' THEN 'SUPPLY' WHEN 'purchase' THEN 'MACRO' WHEN 'signup' THEN 'OPEC_POLICY' WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'INVENTORY' ELSE 'CHINA_ADJUSTMENT' END END"


@query("e9b_expiry_by_rule", f"""
WITH r AS (SELECT id, {_RULED} AS category, event_date, published_at, user_id, max(event_date) FILTER (event_date <= CAST({NOW} AS DATE)) OVER (PARTITION BY source) AS market_date FROM v_signals),
x AS (SELECT *, event_date + CAST(user_id % 9 AS INT) AS effective_until, {NOW} - to_hours(CAST(user_id % 31 AS INT)) AS checked, CAST(date_trunc('week', CAST({NOW} AS DATE)) AS DATE) - 5 AS latest_release FROM r),
e AS (SELECT id, category, CASE
  WHEN category = 'MARKET' AND market_date = event_date THEN {NOW} - INTERVAL 2 HOUR + INTERVAL 1 DAY
  WHEN category = 'SUPPLY' AND event_date <= CAST({NOW} AS DATE) THEN CAST(event_date AS TIMESTAMP) + INTERVAL 3 DAY
  WHEN category = 'MACRO' AND event_date <= CAST({NOW} AS DATE) THEN CAST(event_date AS TIMESTAMP) + INTERVAL 7 DAY
  WHEN category = 'OPEC_POLICY' AND checked > {NOW} - INTERVAL 1 DAY THEN CAST(effective_until AS TIMESTAMP)
  WHEN category = 'INVENTORY' AND checked > {NOW} - INTERVAL 1 DAY AND latest_release <= CAST({NOW} AS DATE) AND user_id % 4 = 0 AND event_date = latest_release - 2 THEN CAST(latest_release + 7 AS TIMESTAMP) + INTERVAL 15 HOUR
  WHEN category = 'CHINA_ADJUSTMENT' AND checked > {NOW} - INTERVAL 1 DAY THEN checked + INTERVAL 1 DAY END AS expires FROM x)
SELECT id, category, CASE WHEN expires > {NOW} THEN expires END AS expires_at FROM e
""")
def e9b(t: Tables) -> DataFrame:
    """Signals with what the rules ask for: the source's last price date, a policy's end, releases on Wednesdays, and when each was checked."""
    user = F.col("user_id")
    kind = F.create_map(*[F.lit(x) for kv in {"view": "MARKET", "click": "SUPPLY", "purchase": "MACRO", "signup": "OPEC_POLICY"}.items() for x in kv])[F.col("category")]
    kind = F.coalesce(kind, F.when(user % 2 == 0, "INVENTORY").otherwise("CHINA_ADJUSTMENT"))
    last = F.max(F.when(F.col("event_date") <= F.to_date(now()), F.col("event_date")))
    prices = t.signals.groupBy("source").agg(last.alias("market_date"))
    checked, release = now() - F.make_dt_interval(hours=(user % 31).cast("int")), F.date_sub(F.trunc(F.to_date(now()), "week"), 5)
    rows = t.signals.join(F.broadcast(prices), "source").select(
        "id", kind.alias("category"), "event_date", "market_date", (now() - F.expr("INTERVAL 2 HOUR")).alias("made_at"), F.date_add("event_date", (user % 9).cast("int")).alias("effective_until"),
        *[checked.alias(f"{c}_checked_at") for c in ("policy", "inventory", "china")], release.alias("latest_release"), F.date_sub(release, 2).alias("observed_week"),
        F.when(user % 4 == 0, release).alias("released_on"), (F.date_add(release, 7).cast("timestamp_ntz") + F.expr("INTERVAL 15 HOUR")).alias("next_release_at"),
    )
    return rows.select("id", "category", ev.expiry_by_rule(now()).alias("expires_at"))


@query("e10_valid_until", f"SELECT event_key, least(max(published_at) + INTERVAL 1 DAY, min({EXPIRES})) AS valid_until FROM v_signals GROUP BY ALL")
def e10(t: Tables) -> DataFrame:
    e = ev.expiry(F.col("category"), F.col("published_at"), DAYS)
    return t.signals.groupBy("event_key").agg(F.least(F.max("published_at") + F.expr("INTERVAL 1 DAY"), F.min(e)).alias("valid_until"))


@query("e11_category_checks", "WITH c AS (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'policy']) AS category) SELECT c.category, count(*) FILTER (s.structured AND s.importance = 3) AS verified, CASE WHEN count(*) FILTER (s.structured AND s.importance = 3) > 0 THEN 'VERIFIED' WHEN count(s.id) > 0 THEN 'FAILED' ELSE 'NO_QUALIFIED_SIGNAL' END AS status FROM c LEFT JOIN v_signals s ON s.category = c.category GROUP BY ALL")
def e11(t: Tables) -> DataFrame:
    names = t.spark.sql("SELECT explode(array('view', 'click', 'purchase', 'signup', 'error', 'policy')) AS category")
    return ev.category_checks(names, t.signals, "category", F.col("structured") & (F.col("importance") == 3))


@query("e12_evidence_gate", "SELECT event_date, array_to_string(list_filter([CASE WHEN count(DISTINCT category) < 5 THEN 'CATEGORIES' END, CASE WHEN count(*) FILTER (category = 'purchase' AND value > 0 AND published_at >= CAST(event_date AS TIMESTAMP) + INTERVAL 12 HOUR) = 0 THEN 'NO_FRESH_MARKET' END, CASE WHEN count(DISTINCT source) FILTER (category IN ('click', 'signup')) < 2 THEN 'PUBLISHERS' END, CASE WHEN count(*) FILTER (direction = 'UP' AND importance = 3) > 0 AND count(*) FILTER (direction = 'DOWN' AND importance = 3) > 0 THEN 'CONFLICT' END], lambda x: x IS NOT NULL), ',') AS codes FROM v_signals GROUP BY ALL")
def e12(t: Tables) -> DataFrame:
    fresh = (F.col("category") == "purchase") & (F.col("value") > 0) & (F.col("published_at") >= F.col("event_date").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS"))
    return ev.evidence_gate(t.signals, ["event_date"], 5, fresh, F.col("category").isin("click", "signup"))


@query("e13_conclusion_gate", "SELECT event_key, CASE WHEN count(*) FILTER (direction = 'UP' AND importance = 3) > 0 AND count(*) FILTER (direction = 'DOWN' AND importance = 3) > 0 THEN 'SIDEWAYS' WHEN count(*) FILTER (direction = 'UP' AND importance = 3) > 0 THEN 'UP' WHEN count(*) FILTER (direction = 'DOWN' AND importance = 3) > 0 THEN 'DOWN' ELSE 'NONE' END AS conclusion, count(*) FILTER (direction = 'NEUTRAL') AS counter_evidence FROM v_signals GROUP BY ALL")
def e13(t: Tables) -> DataFrame:
    main = lambda d: F.count_if((F.col("direction") == d) & (F.col("importance") == 3))
    g = t.signals.groupBy("event_key").agg(main("UP").alias("u"), main("DOWN").alias("d"), F.count_if(F.col("direction") == "NEUTRAL").alias("counter_evidence"))
    c = F.when((F.col("u") > 0) & (F.col("d") > 0), "SIDEWAYS").when(F.col("u") > 0, "UP").when(F.col("d") > 0, "DOWN").otherwise("NONE")
    return g.select("event_key", c.alias("conclusion"), "counter_evidence")


@query("e14_grounding", "SELECT r.conv_id, r.turn FROM conversations r WHERE r.role = 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = r.conv_id AND u.turn < r.turn AND u.text = r.text)")
def e14(t: Tables) -> DataFrame:
    c = t["conversations"]
    said = c.where("role = 'assistant'").alias("r")
    return said.join(c.alias("u"), F.expr("u.conv_id = r.conv_id and u.turn < r.turn and u.text = r.text"), "left_anti").select("conv_id", "turn")


def reason_codes(t: Tables, events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    r = events.select(F.col("user_id").alias("forecast"), pos.alias("pos"), F.when(k % 11 == 0, -1).when(k % 13 == 0, k - k % 150).otherwise(k).alias("evidence_id"), F.lit("UP").alias("direction"))
    return ev.validate_reasons(r, t.signals, "forecast", "pos").select("forecast", "pos", "evidence_id", "code")


@query("e15_validate_reasons", """
WITH r AS (SELECT user_id AS forecast, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS pos, CASE WHEN event_id % 11 = 0 THEN -1 WHEN event_id % 13 = 0 THEN event_id - event_id % 150 ELSE event_id END AS evidence_id FROM events),
j AS (SELECT r.*, s.direction AS d, s.event_key AS e, row_number() OVER (PARTITION BY forecast, evidence_id ORDER BY pos) AS ni, row_number() OVER (PARTITION BY forecast, s.event_key ORDER BY pos) AS ne FROM r LEFT JOIN v_signals s ON s.id = r.evidence_id)
SELECT forecast, pos, evidence_id, CASE WHEN d IS NULL THEN 'UNKNOWN_EVIDENCE' WHEN ni > 1 THEN 'DUPLICATE_EVIDENCE' WHEN d <> 'UP' THEN 'WRONG_DIRECTION' WHEN ne > 1 THEN 'DUPLICATE_EVENT' WHEN pos >= 3 THEN 'TOO_MANY' END AS code FROM j
""")
def e15(t: Tables) -> DataFrame:
    return reason_codes(t, t["events"])


@query("e16_cards", "SELECT event_key, direction, min(id) AS id FROM v_signals WHERE importance >= 2 AND direction <> 'NEUTRAL' GROUP BY ALL")
def e16(t: Tables) -> DataFrame:
    used = t.signals.where("importance >= 2 and direction != 'NEUTRAL'").select("id")
    cards = t.signals.join(used, "id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("event_key", "direction").orderBy("id")))
    return cards.where("n = 1").select("event_key", "direction", "id")


# packages of six: the signals of a user, in order; a third of them is unconfirmed
@query("e17_admit_package", f"""
WITH r AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY published_at, id) - 1) / 7) AS BIGINT) AS package FROM v_signals),
g AS (SELECT user_id, package, max(published_at) AS made FROM r GROUP BY ALL)
SELECT r.user_id, r.package, array_to_string(list_filter([CASE WHEN count(*) NOT BETWEEN 1 AND 6 THEN 'COUNT' END, CASE WHEN count(DISTINCT event_key) < count(*) THEN 'DUPLICATE_EVENT' END, CASE WHEN any_value(made) > {NOW} THEN 'PACKAGE_FUTURE' END, CASE WHEN {NOW} - any_value(made) >= INTERVAL 24 HOUR THEN 'PACKAGE_STALE' END,
  CASE WHEN count(*) FILTER (published_at < made - INTERVAL 72 HOUR) > 0 THEN 'SIGNAL_STALE' END, CASE WHEN count(*) FILTER (id % 3 = 0 AND (structured OR importance = 3)) > 0 THEN 'CONFIRMATION' END], lambda x: x IS NOT NULL), ',') AS codes
FROM r JOIN g ON g.user_id = r.user_id AND g.package = r.package GROUP BY r.user_id, r.package
""")
def e17(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("published_at", "id"))
    s = t.signals.withColumn("package", F.floor((place - 1) / 7))
    return ev.admit_packages(s, ["user_id", "package"], "published_at", "event_key", F.col("id") % 3 == 0, F.col("structured") | (F.col("importance") == 3), now())


@query("e18_merge_evidence", "WITH a AS (SELECT * FROM v_signals WHERE structured), x AS (SELECT * FROM v_signals s WHERE NOT structured AND importance = 3 AND NOT EXISTS (SELECT 1 FROM v_signals u WHERE u.event_key = s.event_key AND u.event_date = s.event_date AND u.importance = 1)) SELECT x.event_key, count(DISTINCT x.id) AS external, count(DISTINCT a.id) AS overlapping, count(DISTINCT a.id) FILTER (a.direction <> x.direction AND a.direction <> 'NEUTRAL' AND x.direction <> 'NEUTRAL') > 0 AS conflict FROM x LEFT JOIN a ON a.event_key = x.event_key GROUP BY ALL")
def e18(t: Tables) -> DataFrame:
    s = t.signals
    used = s.where("importance = 1").select("event_key", "event_date")
    x = s.where("not structured and importance = 3").join(used, ["event_key", "event_date"], "left_anti")
    # both sides are counted by key before they meet, so no pair of signals is made
    ways = lambda df, p: df.groupBy("event_key").agg(F.count(F.lit(1)).alias(f"{p}_n"), *[F.count_if(F.col("direction") == d).alias(f"{p}_{d}") for d in ("UP", "DOWN")])
    j = ways(x, "x").join(ways(s.where("structured"), "a"), "event_key", "left").na.fill(0)
    conflict = (F.col("x_UP") > 0) & (F.col("a_DOWN") > 0) | (F.col("x_DOWN") > 0) & (F.col("a_UP") > 0)
    return j.select("event_key", F.col("x_n").alias("external"), F.col("a_n").alias("overlapping"), conflict.alias("conflict"))


@query("e19_reconcile", "WITH a AS (SELECT week, open_interest AS v FROM v_positions WHERE week < DATE '2001-01-01'), b AS (SELECT week, CASE WHEN month(week) = 3 THEN open_interest + 10 ELSE open_interest END AS v FROM v_positions WHERE week >= DATE '1996-01-01') SELECT coalesce(a.week, b.week) AS week, a.v AS first, b.v AS second, CASE WHEN a.v IS NULL THEN 'MISSING_FIRST' WHEN b.v IS NULL THEN 'MISSING_SECOND' WHEN abs(a.v - b.v) > 5 THEN 'DIFFERS' ELSE 'MATCH' END AS code FROM a FULL JOIN b ON a.week = b.week")
def e19(t: Tables) -> DataFrame:
    p = t.positions.select("week", F.col("open_interest").alias("v"))
    b = p.where("week >= date'1996-01-01'").withColumn("v", F.when(F.month("week") == 3, F.col("v") + 10).otherwise(F.col("v")))
    return ev.reconcile(p.where("week < date'2001-01-01'"), b, ["week"], "v", 5)


PROSE = {"stocks": (r"(?i)stocks (increased|decreased) ([\d.]+) thousand", "change"), "production": (r"(?i)production (increased|decreased) to ([\d.]+) thousand", "level")}
_TEXT = "k % 7"  # what the summary of a week is like: 0 absent, 1 a week behind, 2 without a date, 3 right, 4 with other figures, 5 of an old week, 6 on stocks only


@query("e19b_reconcile_release", f"""
WITH p AS (SELECT week, open_interest AS s, long_qty AS l, CAST(datediff('day', DATE '1970-01-05', week) // 7 AS INT) AS k FROM v_positions),
j AS (SELECT a.week, a.k, a.s, a.l, b.s AS ps, b.l AS pl FROM p a JOIN p b ON b.week = a.week - 7),
m AS (SELECT week AS period, k, 'stocks' AS measure, s / 1000 AS current, ps / 1000 AS previous FROM j UNION ALL SELECT week, k, 'production', l / 1000, pl / 1000 FROM j),
x AS (SELECT *, round(current - previous, 3) AS change, {_TEXT} AS t, k % 5 AS n FROM m)
SELECT period, measure, round(current, 6) AS current, change, CASE
  WHEN measure = 'stocks' AND k % 11 = 0 THEN 'AUTHORITY_WEEK_MISSING' WHEN measure = 'stocks' AND k % 13 = 0 THEN 'AUTHORITY_VALUE_CONFLICT'
  WHEN t = 5 OR n = 4 THEN 'SECONDARY_DATE_CONFLICT' WHEN t = 4 THEN 'SECONDARY_VALUE_CONFLICT' ELSE 'OK' END AS code,
  array_to_string(list_filter([CASE t WHEN 0 THEN 'SUMMARY_UNAVAILABLE' WHEN 1 THEN 'SUMMARY_LAGGING_CURRENT_RELEASE' WHEN 2 THEN 'SUMMARY_DATE_UNPARSED' WHEN 5 THEN NULL ELSE CASE WHEN t = 6 AND measure = 'production' THEN 'SUMMARY_PARTIAL_CONFIRMATION' ELSE 'SUMMARY_CONFIRMS_CURRENT_RELEASE' END END,
    CASE n WHEN 0 THEN 'LANDING_UNAVAILABLE' WHEN 1 THEN 'LANDING_LAGGING_CURRENT_RELEASE' WHEN 2 THEN 'LANDING_DATE_UNPARSED' WHEN 3 THEN 'LANDING_CONFIRMS_CURRENT_RELEASE' END,
    CASE WHEN t = 1 OR n = 1 THEN 'SOURCE_PROPAGATION_LAG' END, CASE WHEN k % 3 = 0 THEN 'AWAITING_NEW_MACHINE_RELEASE' END], lambda x: x IS NOT NULL), ',') AS diagnostics
FROM x
""")
def e19b(t: Tables) -> DataFrame:
    """Releases of weekly positions: the authority has stocks, the table both measures, and a summary and a landing page of each week agree, lag, lack a date, or do not fit."""
    from ..operators.asof import calendar_lag

    p = calendar_lag(t.positions.select("week", "open_interest", "long_qty"), [], "week", ["open_interest", "long_qty"], 1).where("open_interest_lag1 is not null")
    k = F.floor(F.datediff("week", F.lit("1970-01-05").cast("date")) / 7).cast("int")
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), (F.col(c) / 1000).alias("table_current"), (F.col(f"{c}_lag1") / 1000).alias("table_previous")) for m, c in (("stocks", "open_interest"), ("production", "long_qty"))]))
    rows = p.select("*", k.alias("k"), both.alias("m")).select("*", "m.*").withColumn("period", F.col("week"))
    text, off = F.col("k") % 7, F.when(F.col("k") % 7 == 4, 0.2).otherwise(0.0)
    of = lambda c: F.round((F.col(c) - F.col(f"{c}_lag1")) / 1000, 3)
    figure = lambda x: F.format_string("%.1f", x)
    way = lambda x: F.when(x < 0, "decreased").otherwise("increased")
    ended = F.date_format(F.when(text == 1, F.date_sub("week", 7)).when(text == 5, F.date_sub("week", 14)).otherwise(F.col("week")), "MMMM d, yyyy")
    stocks = F.concat(F.lit("stocks "), way(of("open_interest")), F.lit(" "), figure(F.abs(of("open_interest")) + off), F.lit(" thousand."))
    production = F.when(text == 6, F.lit("")).otherwise(F.concat(F.lit(" Production "), way(of("long_qty")), F.lit(" to "), figure(F.col("long_qty") / 1000 + off), F.lit(" thousand a day.")))
    summary = F.when(text == 0, None).otherwise(F.concat(F.when(text == 2, F.lit("This week, ")).otherwise(F.concat(F.lit("For the week ending "), ended, F.lit(", "))), stocks, production))
    landing, release = F.col("k") % 5, F.date_add("week", 9)
    shown = F.date_format(F.when(landing == 1, F.date_sub(release, 7)).when(landing == 4, F.date_sub(release, 21)).otherwise(release), "yyyy_MM_dd")
    page = F.when(landing == 0, None).when(landing == 2, F.lit("<a href=/archive/latest/>latest</a>")).otherwise(F.concat(F.lit("<a href=/archive/"), F.substring(shown, 1, 4), F.lit("/"), shown, F.lit("/report>")))
    authority = lambda c, bad: F.when(bad, F.col(c) + 10).otherwise(F.col(c))
    ready = rows.select(
        "period", "measure", "table_current", "table_previous", (F.col("measure") == "stocks").alias("has_authority"), F.when(F.col("k") % 11 != 0, authority("open_interest", F.col("k") % 13 == 0)).alias("authority_current"), F.col("open_interest_lag1").alias("authority_previous"),
        summary.alias("summary"), page.alias("landing"), release.alias("release_date"), F.date_sub(release, 7).alias("prior_release_date"), F.date_add("week", 16).alias("next_release_at"), F.date_add("week", F.when(F.col("k") % 3 == 0, 16).otherwise(15)).alias("checked_at"),
    )
    got = ev.reconcile_release(ready, PROSE)
    return got.select("period", "measure", F.round("current", 6).alias("current"), "change", "code", F.array_join("diagnostics", ",").alias("diagnostics"))


@query("e20_measure_signals", "SELECT p.week, CASE WHEN p.spread_qty > q.spread_qty THEN 'DOWN' WHEN p.spread_qty < q.spread_qty THEN 'UP' WHEN p.spread_qty = q.spread_qty THEN 'NEUTRAL' END AS impact FROM v_positions p LEFT JOIN v_positions q ON q.week = p.week - 7")
def e20(t: Tables) -> DataFrame:
    from ..operators.asof import calendar_lag

    d = F.col("spread_qty") - F.col("spread_qty_lag1")
    p = calendar_lag(t.positions.select("week", "spread_qty"), [], "week", ["spread_qty"], 1)
    return p.select("week", F.when(d > 0, "DOWN").when(d < 0, "UP").when(d == 0, "NEUTRAL").alias("impact"))


@query("e21_scan_secrets", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in ev.DETECTORS) + " END AS detector FROM documents")
def e21(t: Tables) -> DataFrame:
    d = t["documents"]
    return d.select("doc_id", ev.scan_secrets(d, "text").alias("detector"))


@query("e22_collection_summary", "SELECT source, count(*) AS requests, count(*) FILTER (category = 'error') AS failures, count(*) FILTER (category <> 'error') AS successes FROM v_signals GROUP BY ALL")
def e22(t: Tables) -> DataFrame:
    return t.signals.groupBy("source").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("category") == "error").alias("failures"), F.count_if(F.col("category") != "error").alias("successes"))


@query("e23_append_only", "SELECT CAST(0 AS BIGINT) AS changed, count(*) AS added, (SELECT count(*) FROM (SELECT cycle_date FROM v_cycles GROUP BY ALL HAVING count(*) > 1)) AS repeated FROM v_cycles WHERE cycle_date = (SELECT max(cycle_date) FROM v_cycles)")
def e23(t: Tables) -> DataFrame:
    last = t.cycles.agg(F.max("cycle_date").alias("last"))
    old = t.cycles.join(F.broadcast(last), F.col("cycle_date") < F.col("last")).drop("last")
    return ev.append_only_check(old, t.cycles, "cycle_date")


@query("e24_verify_history", "SELECT doc_id, CASE WHEN doc_id % 101 = 0 THEN 'CHANGED' ELSE 'NOT_IN_INDEX' END AS problem FROM documents WHERE doc_id % 101 = 0 OR doc_id % 103 = 0")
def e24(t: Tables) -> DataFrame:
    d = t["documents"]
    stored = F.when(F.col("doc_id") % 101 == 0, F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    index = d.where("doc_id % 103 != 0 or doc_id % 101 = 0").select("doc_id", stored.alias("sha256"))
    return ev.verify_history(d, index, "doc_id", "text")


@query("e25_fuzz_grid", "WITH r AS (SELECT CAST(round(100 * p_down) AS BIGINT) AS down, CAST(round(100 * p_flat) AS BIGINT) AS flat, CAST(round(100 * p_up) AS BIGINT) AS up FROM v_probs), k AS (SELECT down, flat, count(*) AS forecasts, count(*) FILTER (down + flat + up = 100) AS whole FROM r GROUP BY ALL) SELECT CAST(a.i AS BIGINT) AS down, CAST(b.i AS BIGINT) AS flat, CAST(100 - a.i - b.i AS BIGINT) AS up, coalesce(k.forecasts, 0) AS forecasts, coalesce(k.whole, 0) AS whole, a.i + b.i <= 100 AS valid FROM range(101) a(i) CROSS JOIN range(101) b(i) LEFT JOIN k ON k.down = a.i AND k.flat = b.i")
def e25(t: Tables) -> DataFrame:
    """All triples from 0 to 100, the 5,151 valid ones and the others, with the forecasts whose percentages round to their first two, and those of them that sum to 100."""
    ps = [F.round(100 * F.col(p)).cast("bigint") for p in ("p_down", "p_flat", "p_up")]
    asked = t.probs.groupBy(ps[0].alias("down"), ps[1].alias("flat")).agg(F.count(F.lit(1)).alias("forecasts"), F.count_if(ps[0] + ps[1] + ps[2] == 100).alias("whole"))
    every = t.spark.range(101).withColumnRenamed("id", "down").withColumn("flat", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(100).cast("bigint"))))
    grid = every.join(asked, ["down", "flat"], "left").select("down", "flat", (100 - F.col("down") - F.col("flat")).alias("up"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("forecasts", "whole")])
    return grid.withColumn("valid", valid_percentages(["down", "flat", "up"]))
