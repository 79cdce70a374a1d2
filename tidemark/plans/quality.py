"""Queries of scans, sinks, gates, limits and set operations (S, P, L, U)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import classify
from ..operators import quality as q
from ..session import shared_dir
from ..sources import scans, stores
from .functions import TO_TEXT
from .registry import Tables, query


def scratch(t: Tables, name: str) -> str:
    """A new place under the folder that all executors share."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


#: The series of the vintage view, a file each.
SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("s1_read_vintage", "SELECT obs_date, release_date, CASE WHEN value >= 1000 THEN value END AS value, '5-LOW' AS series_id FROM v_pit WHERE series_id = '5-LOW'")
def s1(t: Tables) -> DataFrame:
    path = scratch(t, "vintage")
    text = F.when(F.col("value") >= 1000, F.col("value").cast("string")).otherwise(".")
    t.pit.where("series_id = '5-LOW'").select("obs_date", text.alias("value"), "release_date").write.option("header", True).csv(path)
    return scans.read_vintage(t.spark, path, "5-LOW")


@query("s2_merge_vintages", "SELECT obs_date, count(*) AS n FROM (SELECT DISTINCT series_id, obs_date, release_date, value FROM v_pit ) GROUP BY ALL HAVING count(*) > 1")
def s2(t: Tables) -> DataFrame:
    cols = ["series_id", "obs_date", "release_date", "value"]
    each = [t.pit.where(F.col("series_id") == s).select(*cols) for s in SERIES]
    parts = [*each, each[-1]]  # one file is there twice
    return scans.merge_vintages(parts, ["obs_date"])[1]


@query("s3_unpivot_series", "SELECT obs_date, 'a' AS series_id, round(a, 8) AS value FROM v_two WHERE a IS NOT NULL UNION ALL SELECT obs_date, 'b', round(b, 8) FROM v_two WHERE b IS NOT NULL")
def s3(t: Tables) -> DataFrame:
    return scans.unpivot_series(t.two, "obs_date", ["a", "b"]).withColumn("value", F.round("value", 8))


@query("s4_select_variables", "SELECT x.day, round(x.value, 8) AS a, round(y.value, 8) AS b FROM v_long x JOIN v_long y ON x.day = y.day WHERE x.variable = 'A' AND x.unit = 'F' AND y.variable = 'R' AND y.unit = 'F'")
def s4(t: Tables) -> DataFrame:
    return scans.select_variables(t.long.withColumn("value", F.round("value", 8)), "day", ("A", "F"), ("R", "F"))


@query("s5_panel_long", "WITH w AS (SELECT obs_date, CASE WHEN a > 50000 THEN a / 1000 END AS a, CASE WHEN b > 50000 THEN b / 1000 END AS b FROM v_two) SELECT obs_date, 'a' AS entity, round(a, 8) AS value FROM w WHERE coalesce(a, b) IS NOT NULL UNION ALL SELECT obs_date, 'b', round(b, 8) FROM w WHERE coalesce(a, b) IS NOT NULL")
def s5(t: Tables) -> DataFrame:
    wide = t.two.withColumns({c: F.when(F.col(c) > 50000, F.col(c)).otherwise(-1.0) for c in "ab"})
    return scans.panel_long(wide, "obs_date", ["a", "b"]).withColumn("value", F.round("value", 8))


@query("s6_release_cells", "SELECT series_id, obs_date, value, available_at FROM v_pit QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY available_at, value) = 1")
def s6(t: Tables) -> DataFrame:
    return scans.release_cells(t.pit, ["series_id"], "obs_date", "available_at", "value")


CELLS = {"stock": ("A", "F"), "inputs": ("N", "O")}


@query("s6b_release_tables", "SELECT week, available_at, stock, inputs FROM (SELECT release, week, release + 1 AS available_at, max(CASE WHEN s1 = 'A' AND s2 = 'F' THEN v END) AS stock, max(CASE WHEN s1 = 'N' AND s2 = 'O' THEN v END) AS inputs FROM (SELECT CAST(o_orderdate AS DATE) AS release, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS week, l_returnflag AS s1, l_linestatus AS s2, CAST(round(sum(l_quantity)) AS DOUBLE) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY ALL) WHERE stock IS NOT NULL AND inputs IS NOT NULL QUALIFY row_number() OVER (PARTITION BY week ORDER BY release) = 1")
def s6b(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    cells = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).groupBy(day.alias("release"), F.col("l_returnflag").alias("stub1"), F.col("l_linestatus").alias("stub2")).agg(F.format_number(F.sum("l_quantity"), 0).alias("value"))
    tables = cells.withColumns({"week": F.to_date(F.date_trunc("quarter", "release")), "available_at": F.date_add("release", 1)})
    return scans.release_tables(tables, CELLS, "release", "week", "available_at")


@query("s7_read_positions", "SELECT week, long_qty, short_qty FROM v_positions")
def s7(t: Tables) -> DataFrame:
    path, numbers = scratch(t, "positions"), ["long_qty", "short_qty"]
    t.positions.select(F.lit("022651").alias("code"), F.col("week").cast("string"), *[F.col(c).cast("string") for c in numbers]).write.json(path)
    return scans.read_positions(t.spark, path, {"code": "022651"}, "week", numbers)


@query("s8_table_rows", "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) - 1 AS INT) AS pos, l_returnflag AS \"group\", CAST(l_linenumber AS VARCHAR) AS area, CASE WHEN l_quantity > 10 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS price FROM lineitem")
def s8(t: Tables) -> DataFrame:
    """A page for each order, whose table names a return flag only where it changes, and has no price where little was sold."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity"]
    before = F.lag("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy(*order))  # an order has a few lines
    cell = lambda kind, x: F.concat(F.lit(f'<td class="{kind}">'), x, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), F.when(before.eqNullSafe(F.col("l_returnflag")), "").otherwise(cell("s1", F.concat(F.lit("<b>"), F.col("l_returnflag"), F.lit("</b>")))), cell("s2", F.col("l_linenumber").cast("string")), F.when(F.col("l_quantity") > 10, cell("d1", F.col("l_quantity").cast("bigint").cast("string"))).otherwise(F.lit("")), F.lit("</tr>"))
    rows = t["lineitem"].select("l_orderkey", F.struct(*order, row.alias("row")).alias("r"))
    pages = rows.groupBy("l_orderkey").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "\n"), F.lit("</table>")).alias("html"))
    return scans.table_rows(pages, ["l_orderkey"], "html", "s1", {"area": "s2", "price": "d1"})


@query("s8b_list_items", "WITH r AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1, 's') AS r FROM pages), e AS (SELECT page_id, unnest(r) AS cell, generate_subscripts(r, 1) - 1 AS pos FROM r) SELECT page_id, CAST(pos AS INT) AS pos, trim(regexp_replace(cell, '<[^>]*>', '', 'g')) AS cell, first_value(trim(regexp_replace(cell, '<[^>]*>', '', 'g'))) OVER (PARTITION BY page_id ORDER BY pos) AS header FROM e")
def s8b(t: Tables) -> DataFrame:
    cells = t["pages"].select("page_id", F.posexplode(scans.list_items(F.col("html"))).alias("pos", "cell"))
    return scans.carry_down(cells.withColumn("header", F.when(F.col("pos") == 0, F.col("cell"))), ["page_id"], "pos", "header")


# 30 items of a feed and 200 of a sitemap, with their places
def items_in_order(t: Tables, cap: int) -> DataFrame:
    return t["pages"].select("page_id", F.posexplode(scans.feed_items(F.col("html"), "p", cap)).alias("pos", "item"))


ITEMS = "WITH r AS (SELECT page_id, regexp_extract_all(html, '<p[^>]*>(.*?)</p>', 1, 's')[1:{}] AS r FROM pages) SELECT page_id, CAST(generate_subscripts(r, 1) - 1 AS INT) AS pos, unnest(r) AS item FROM r"


@query("s9_feed_items", ITEMS.format(30))
def s9_feed(t: Tables) -> DataFrame:
    return items_in_order(t, 30)


@query("s9_sitemap_items_200", ITEMS.format(200))
def s9_sitemap(t: Tables) -> DataFrame:
    return items_in_order(t, 200)


def feeds(t: Tables) -> DataFrame:
    """A feed and a sitemap for each page, with an item for each of its paragraphs: titles by turns in CDATA and escaped, addresses with an ampersand."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    inner = F.regexp_extract_all("html", F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    title = lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("<![CDATA["), x, F.lit("]]>"))).otherwise(escaped(x))
    link = lambda i: escaped(F.concat("url", F.lit("?item="), i.cast("string"), F.lit("&from=feed")))
    item = lambda x, i: F.concat(F.lit("<item><title>"), title(x, i), F.lit("</title>\n<link>"), link(i), F.lit("</link><guid>"), i.cast("string"), F.lit("</guid><pubDate>Day "), i.cast("string"), F.lit("</pubDate></item>"))
    news = lambda x, i: F.concat(F.lit("<url><loc>"), link(i), F.lit("</loc><news:news><news:publication_date>Day "), i.cast("string"), F.lit("</news:publication_date><news:title>"), title(x, i), F.lit("</news:title></news:news></url>"))
    rss = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>all</title>'), F.array_join(F.transform(inner, item), ""), F.lit("</channel></rss>"))
    sitemap = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">'), F.array_join(F.transform(inner, news), ""), F.lit("</urlset>"))
    return t["pages"].select("page_id", rss.alias("rss"), sitemap.alias("sitemap"))


_FEED = "WITH r AS (SELECT page_id, url, regexp_extract_all(html, '<p[^>]*>(.*?)</p>', 1, 's') AS r FROM pages), i AS (SELECT page_id, url, unnest(range(len(r))) AS i, r FROM r), x AS (SELECT page_id, i, {title} AS title, url || '?item=' || i || '&from=feed' AS link, 'Day ' || i AS published FROM i)".format(title=TO_TEXT.format("r[i + 1]"))


@query("s9b_rss_items", f"{_FEED} SELECT page_id, CAST(i AS INT) AS pos, title, link, published FROM x WHERE i < 30")
def s9b(t: Tables) -> DataFrame:
    return feeds(t).select("page_id", F.posexplode(scans.rss_items(F.col("rss"))).alias("pos", "item")).select("page_id", "pos", "item.*")


@query("s9c_sitemap_urls", f"{_FEED} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS pos, title, link, published FROM x WHERE title <> '' AND link LIKE 'https://%' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 200")
def s9c(t: Tables) -> DataFrame:
    return feeds(t).select("page_id", F.posexplode(scans.sitemap_urls(F.col("sitemap"), "https://")).alias("pos", "item")).select("page_id", "pos", "item.*")


@query("s10_recent_context", "WITH r AS (SELECT * FROM v_two WHERE a IS NOT NULL AND b IS NOT NULL ORDER BY obs_date DESC LIMIT 8) SELECT count(*) AS n, min(obs_date) AS first_day, max(obs_date) AS last_day, round(min_by(a, obs_date), 8) AS first_a, round(max_by(a, obs_date), 8) AS last_a, round(min_by(b, obs_date), 8) AS first_b, round(max_by(b, obs_date), 8) AS last_b FROM r HAVING count(*) >= 5")
def s10(t: Tables) -> DataFrame:
    got = scans.recent_context(t.two, "obs_date", ["a", "b"], 8, 5)
    return got.withColumns({c: F.round(c, 8) for c in ("first_a", "last_a", "first_b", "last_b")})


@query("s11_provenance_sink", "SELECT series_id, count(*) AS n FROM v_pit GROUP BY ALL")
def s11(t: Tables) -> DataFrame:
    path = scratch(t, "provenance")
    stores.write_provenance(t.pit.select("series_id", "obs_date", "available_at", "value"), path)
    return t.spark.read.schema("series_id string, value double").json(path).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("s12_append_snapshot", "SELECT series_id, count(*) AS n FROM v_weekly GROUP BY ALL")
def s12(t: Tables) -> DataFrame:
    path, early = scratch(t, "snapshots"), F.col("week") < "1998-01-01"
    stores.append_snapshot(t.weekly.where(early), path, ["series_id", "week"])
    stores.append_snapshot(t.weekly.where(~early), path, ["series_id", "week"])
    return stores.read_snapshots(t.spark, path).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("s13_publish_current", "SELECT series_id, max(week) AS last_week FROM v_weekly GROUP BY ALL")
def s13(t: Tables) -> DataFrame:
    path = scratch(t, "current")
    good = t.weekly.groupBy("series_id").agg(F.max("week").alias("last_week"))
    stores.publish_current(good, path, True)
    stores.publish_current(good.limit(0), path, False)
    return stores.read_current(t.spark, path)


@query("s14_verify_manifest", "SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 97 = 0 THEN 'CHANGED' ELSE 'ADDED' END AS change FROM documents WHERE doc_id % 97 = 0 OR doc_id % 89 = 0")
def s14(t: Tables) -> DataFrame:
    d = t["documents"].select(F.col("doc_id").cast("string").alias("name"), "doc_id", "text")
    old = d.where("doc_id % 89 != 0 or doc_id % 97 = 0").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return stores.verify_manifest(stores.manifest(d, "name", "text"), stores.manifest(old, "name", "text"))


@query("s15_build_manifest", "SELECT CAST(doc_id AS VARCHAR) AS name, sha256(coalesce(text, '')) AS sha256 FROM documents")
def s15(t: Tables) -> DataFrame:
    return stores.manifest(t["documents"].withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text")


@query("p1_classify", "SELECT event_id, CASE WHEN value - 8 > 2 THEN 'UP' WHEN value - 8 < -2 THEN 'DOWN' ELSE 'FLAT' END AS class FROM events")
def p1(t: Tables) -> DataFrame:
    return t["events"].select("event_id", classify(F.col("value") - 8, 2.0).alias("class"))


@query("p2_quarantine", "SELECT series_id, 'RELEASE_PRECEDES_OBSERVATION' AS reason, count(*) AS n, min(release_date) AS first_release FROM v_vintage WHERE release_date < obs_date GROUP BY ALL")
def p2(t: Tables) -> DataFrame:
    bad = q.quarantine(t.vintage, q.quarantine_reason())[1]
    return bad.groupBy("series_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("release_date").alias("first_release"))


@query("p3_series_exemption", "SELECT series_id, count(*) AS admitted FROM (SELECT series_id, obs_date, release_date, value - 40000 AS value FROM v_vintage) WHERE release_date >= obs_date AND (value > 0 OR series_id = '5-LOW') GROUP BY ALL")
def p3(t: Tables) -> DataFrame:
    good = q.quarantine(t.vintage.withColumn("value", F.col("value") - 40000), q.quarantine_reason(allow_negative=("5-LOW",)))[0]
    return good.groupBy("series_id").agg(F.count(F.lit(1)).alias("admitted"))


@query("p4_parse_number", "SELECT event_id, round(CASE WHEN value * 1000 >= 1 AND event_id % 5 <> 0 THEN CAST(floor(value * 1000) AS DOUBLE) END, 2) AS number FROM events")
def p4(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, F.lit("1,23,4")).otherwise(F.format_number(F.floor(F.col("value") * 1000), 0))
    return t["events"].select("event_id", q.parse_number(text).alias("number"))


@query("p5_valid_date", "SELECT event_id, try_cast(d AS DATE) IS NOT NULL AND regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS valid FROM (SELECT event_id, '2026-' || lpad(CAST(1 + event_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + event_id % 31 AS VARCHAR), 2, '0') AS d FROM events)")
def p5(t: Tables) -> DataFrame:
    two = lambda n: F.lpad((1 + F.col("event_id") % n).cast("string"), 2, "0")
    return t["events"].select("event_id", q.valid_date(F.concat_ws("-", F.lit("2026"), two(14), two(31))).alias("valid"))


@query("p6_project_strict", "SELECT n_name, n_nationkey, n_regionkey FROM nation")
def p6(t: Tables) -> DataFrame:
    return q.project_strict(t["nation"], ["n_name", "n_nationkey", "n_regionkey"])


@query("p7_record_gate", "SELECT event_id, array_to_string(list_filter([CASE WHEN value > 20 OR value < 0.1 THEN 'RANGE' END, CASE WHEN event_type = 'error' THEN 'STATUS' END, CASE WHEN user_id % 10 = 0 THEN 'UNIT' END], lambda x: x IS NOT NULL), ',') AS codes FROM events")
def p7(t: Tables) -> DataFrame:
    rules = {"RANGE": (F.col("value") > 20) | (F.col("value") < 0.1), "STATUS": F.col("event_type") == "error", "UNIT": F.col("user_id") % 10 == 0}
    return q.record_gate(t["events"], rules).select("event_id", "codes")


@query("p8_completeness", "SELECT n_nationkey AS nation, 'MISSING' AS issue FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def p8(t: Tables) -> DataFrame:
    have = t["supplier"].where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return q.completeness_gate(have, t["nation"].select(F.col("n_nationkey").alias("nation")), "nation")


@query("p9_violations", "SELECT 'early' AS \"check\", count(*) FILTER (release_date < obs_date) AS violations FROM v_vintage UNION ALL SELECT 'price', count(*) FILTER (value <= 0) FROM v_vintage")
def p9(t: Tables) -> DataFrame:
    return q.violations(t.vintage, {"early": F.col("release_date") < F.col("obs_date"), "price": F.col("value") <= 0})


@query("p9b_violations_of_a_write", "SELECT 'early' AS \"check\", count(*) FILTER (release_date < obs_date) AS violations, count(*) AS rows FROM v_vintage UNION ALL SELECT 'price', count(*) FILTER (value <= 0), count(*) FROM v_vintage")
def p9b(t: Tables) -> DataFrame:
    path = scratch(t, "checked")
    counts = q.write_counted(t.vintage, path, {"early": F.col("release_date") < F.col("obs_date"), "price": F.col("value") <= 0})
    return counts.crossJoin(F.broadcast(t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))))


@query("p10_gate", "SELECT 'FAIL' AS status, 'early' AS failed, count(*) AS checks FROM (VALUES ('early'), ('price')) v HAVING (SELECT count(*) FROM v_vintage WHERE release_date < obs_date) > 0")
def p10(t: Tables) -> DataFrame:
    counts = q.violations(t.vintage, {"early": F.col("release_date") < F.col("obs_date"), "price": F.col("value") <= 0})
    return q.gate(counts.select("check", (F.col("violations") == 0).alias("passed")))


@query("p11_cross_check", "SELECT series_id, obs_date, round(value, 8) AS value, 'FIRST' AS side FROM v_daily WHERE year(obs_date) = 1999")
def p11(t: Tables) -> DataFrame:
    d = t.written.daily.select("series_id", "obs_date", F.round("value", 8).alias("value"))  # one read twice, not two that may round differently
    return q.cross_check(d, d.where(F.year("obs_date") != 1999))


@query("p12_revision_diff", "SELECT entity, week, round(value, 8) AS old_value, CASE WHEN year(week) = 1996 THEN round(value, 8) + 1 END AS new_value, CASE WHEN year(week) = 1996 THEN 'CHANGED' ELSE 'REMOVED' END AS change FROM v_panel WHERE year(week) IN (1996, 1997)")
def p12(t: Tables) -> DataFrame:
    old = t.panel.withColumn("value", F.round("value", 8))
    new = old.where(F.year("week") != 1997).withColumn("value", F.when(F.year("week") == 1996, F.col("value") + 1).otherwise(F.col("value")))
    return q.revision_diff(old, new, ["entity", "week"], "value", 0.5)


MEDIANS = "SELECT a.week, median(ln(a.value / b.value)) AS r FROM {p} a JOIN {p} b ON a.entity = b.entity AND b.week = a.week - 7 GROUP BY a.week HAVING count(*) >= 20"


EDITED = "SELECT entity, week, CASE WHEN entity = 'NATION_3' AND year(week) = 1996 THEN value * 1.5 ELSE value END AS value FROM v_panel"


@query("p13_revision_impact", f"WITH f AS ({EDITED}), x AS ({MEDIANS.format(p='v_panel')}), y AS ({MEDIANS.format(p='f')}) SELECT round(max(abs(x.r - y.r)), 6) AS impact FROM x JOIN y ON x.week = y.week")
def p13(t: Tables) -> DataFrame:
    from ..operators.aggregates import matched_median

    edit = F.when((F.col("entity") == "NATION_3") & (F.year("week") == 1996), F.col("value") * 1.5).otherwise(F.col("value"))
    before = matched_median(t.panel, "entity", "week", "value", 20).select("week", F.col("median_return").alias("x"))
    after = matched_median(t.panel.withColumn("value", edit), "entity", "week", "value", 20).select("week", F.col("median_return").alias("y"))
    return before.join(after, "week").agg(F.round(F.max(F.abs(F.col("x") - F.col("y"))), 6).alias("impact"))


@query("p14_admission", "SELECT series_id, n, CAST(span AS INT) AS span, array_to_string(list_filter([CASE WHEN n < 340 THEN 'COVERAGE' END, CASE WHEN span < 365 THEN 'HISTORY' END], lambda x: x IS NOT NULL), ',') AS codes, CASE WHEN n < 340 OR span < 365 THEN 'REJECTED' ELSE 'ADMITTED' END AS decision FROM (SELECT series_id, count(*) AS n, max(week) - min(week) AS span FROM v_weekly GROUP BY ALL)")
def p14(t: Tables) -> DataFrame:
    stats = t.weekly.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.datediff(F.max("week"), F.min("week")).alias("span"))
    return q.admission(stats, {"COVERAGE": F.col("n") < 340, "HISTORY": F.col("span") < 365})


@query("p15_convert", "SELECT p_partkey, round(p_retailprice * 42 - 100, 4) AS crack, CAST(round(p_retailprice * 1000 / 0.84) AS BIGINT) AS per_ton FROM part")
def p15(t: Tables) -> DataFrame:
    price = F.col("p_retailprice")
    return t["part"].select("p_partkey", F.round(price * 42 - 100, 4).alias("crack"), F.round(price * 1000 / 0.84).cast("bigint").alias("per_ton"))


@query("p16_mask_unavailable", "SELECT series_id, obs_date, release_date, CASE WHEN available_at <= obs_date + 90 THEN value END AS value FROM v_pit")
def p16(t: Tables) -> DataFrame:
    return q.mask_unavailable(t.pit.withColumn("decision", F.date_add("obs_date", 90)), ["value"], "available_at", "decision").select("series_id", "obs_date", "release_date", "value")


@query("p17_change_issues", "SELECT event_id, array_to_string(list_filter([CASE WHEN abs(value) > 30 THEN 'CAP' END, CASE WHEN sign(value - 8) <> CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END THEN 'SIGN' END], lambda x: x IS NOT NULL), ',') AS issues FROM events")
def p17(t: Tables) -> DataFrame:
    told = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    rules = {"CAP": F.abs("value") > 30, "SIGN": F.sign(F.col("value") - 8) != told}
    return t["events"].select("event_id", F.array_join(q.reasons(rules), ",").alias("issues"))


@query("p18_map_direction", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' WHEN 2 THEN 'FLAT' END AS direction FROM events")
def p18(t: Tables) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, (" Rise", "fall", "Stable ", "sideways"))), (F.col("event_id") % 4 + 1).cast("int"))
    return t["events"].select("event_id", q.map_direction(word).alias("direction"))


@query("l1_top_k", "SELECT id, rn, CASE WHEN rn > 30 THEN 'DISCOVERY_CANDIDATE_LIMIT' END AS reason FROM (SELECT id, CAST(row_number() OVER (PARTITION BY category, event_date ORDER BY importance DESC, id) AS INT) AS rn FROM v_signals)")
def l1(t: Tables) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("category", "event_date").orderBy(F.desc("importance"), "id"))
    return t.signals.select("id", rn.alias("rn")).withColumn("reason", F.when(F.col("rn") > 30, "DISCOVERY_CANDIDATE_LIMIT"))


@query("l2_tail", "SELECT series_id, obs_date FROM v_daily QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) <= 21")
def l2(t: Tables) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("obs_date")))
    return t.daily.select("series_id", "obs_date", rn.alias("rn")).where("rn <= 21").drop("rn")


@query("l3_budget", "SELECT source, id FROM v_signals QUALIFY row_number() OVER (PARTITION BY source ORDER BY importance DESC, published_at DESC, id) <= 6")
def l3(t: Tables) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("importance"), F.desc("published_at"), "id"))
    return t.signals.withColumn("rn", rn).where("rn <= 6").select("source", "id")


@query("l4_nearest_k", "WITH s AS (SELECT s_suppkey, s_acctbal FROM supplier), c AS (SELECT c_custkey, c_acctbal FROM customer) SELECT s_suppkey, c_custkey FROM s, c QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) <= 5")
def l4(t: Tables) -> DataFrame:
    from ..operators.nearest import nearest_k

    return nearest_k(t["supplier"].select("s_suppkey", "s_acctbal"), t["customer"].select("c_custkey", "c_acctbal"), "s_suppkey", "s_acctbal", "c_custkey", "c_acctbal", 5)


@query("u1_union_all", "SELECT series_id AS name, week AS day FROM v_weekly UNION ALL SELECT entity, week FROM v_panel")
def u1(t: Tables) -> DataFrame:
    return t.weekly.select(F.col("series_id").alias("name"), F.col("week").alias("day")).unionByName(t.panel.select(F.col("entity").alias("name"), F.col("week").alias("day")))


@query("u2_common_dates", "SELECT obs_date FROM v_daily GROUP BY ALL HAVING count(DISTINCT series_id) = 5")
def u2(t: Tables) -> DataFrame:
    return t.daily.groupBy("obs_date").agg(F.count_distinct("series_id").alias("n")).where("n = 5").select("obs_date")


@query("u3_missing_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def u3(t: Tables) -> DataFrame:
    return t["customer"].select("c_custkey").join(t["orders"].select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("u4_distinct", "SELECT DISTINCT event_key, direction FROM v_signals")
def u4(t: Tables) -> DataFrame:
    return t.signals.select("event_key", "direction").dropDuplicates()
