"""Queries of dataset construction, splits, audits and trend rules (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import half_up_step
from ..operators import datasets as ds
from ..operators.ranks import quantiles
from .registry import Tables, query

KEY = ["series_id"]
LABELS = """
SELECT s.series_id, s.day, a.obs_date AS start_date, b.obs_date AS end_date, ln(b.value / a.value) AS label_return, greatest(a.available_at, b.available_at) AS label_known_at
FROM (SELECT s.*, a.obs_date, a.value, a.available_at FROM v_spine s ASOF JOIN v_daily a ON s.series_id = a.series_id AND s.day >= a.obs_date) a
JOIN (SELECT s.*, b.obs_date, b.value, b.available_at FROM v_spine s ASOF JOIN v_daily b ON s.series_id = b.series_id AND s.day + 7 <= b.obs_date) b ON a.series_id = b.series_id AND a.day = b.day
JOIN v_spine s ON s.series_id = a.series_id AND s.day = a.day WHERE a.day - a.obs_date <= 7 AND b.obs_date - (b.day + 7) <= 4
"""


def labels(t: Tables) -> DataFrame:
    return ds.build_labels(t.written.spine, t.written.daily, KEY, 7, 7, 4)


@query("d1_build_labels", f"SELECT series_id, day, start_date, end_date, round(label_return, 6) AS label_return, label_known_at FROM ({LABELS})")
def d1(t: Tables) -> DataFrame:
    return labels(t).withColumn("label_return", F.round("label_return", 6))


@query("d2_snapshots", f"SELECT s.series_id, s.day, CASE WHEN l.day IS NULL THEN 'NO_LABEL' WHEN year(s.day) < 1996 THEN 'WARM_UP' WHEN abs(l.label_return) > 0.5 THEN 'OUTLIER' END AS reason FROM v_spine s LEFT JOIN ({LABELS}) l ON l.series_id = s.series_id AND l.day = s.day")
def d2(t: Tables) -> DataFrame:
    joined = t.written.spine.join(labels(t), ["series_id", "day"], "left")
    reason = ds.exclusion([("NO_LABEL", F.col("label_return").isNull()), ("WARM_UP", F.year("day") < 1996), ("OUTLIER", F.abs("label_return") > 0.5)])
    return joined.select("series_id", "day", reason.alias("reason"))


@query("d3_freeze_threshold", f"SELECT series_id, round(greatest(0.005, floor(quantile_cont(abs(label_return), 0.33) / 0.005 + 0.5) * 0.005), 9) AS threshold FROM ({LABELS}) WHERE year(day) < 1998 GROUP BY ALL")
def d3(t: Tables) -> DataFrame:
    q = quantiles(labels(t).where(F.year("day") < 1998).withColumn("size", F.abs("label_return")), ["series_id"], "size", [0.33])
    return q.select("series_id", F.round(half_up_step("q33", 0.005, 0.005), 9).alias("threshold"))


@query("d4_choose_threshold", f"""
WITH l AS ({LABELS}), c AS (SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS n, count(*) FILTER (label_return < -t) / count(*) AS down, count(*) FILTER (label_return > t) / count(*) AS up FROM l, (VALUES (0.05), (0.1), (0.15), (0.2), (0.3)) v(t) GROUP BY ALL),
s AS (SELECT threshold, down, 1 - down - up AS flat, up FROM c), b AS (SELECT *, least(down, flat, up) >= 0.25 AND greatest(down, flat, up) <= 0.42 AS balanced, round(abs(flat - 1.0 / 3), 9) AS distance FROM s)
SELECT threshold, round(down, 9) AS down, round(up, 9) AS up, balanced, threshold = (SELECT coalesce(min(threshold) FILTER (balanced), min_by(threshold, {{'d': distance, 't': threshold}})) FROM b) AS chosen FROM b
""")
def d4(t: Tables) -> DataFrame:
    got = ds.choose_threshold(labels(t), "label_return", [0.05, 0.1, 0.15, 0.2, 0.3], 0.25, 0.42)
    return got.select("threshold", F.round("down", 9).alias("down"), F.round("up", 9).alias("up"), "balanced", "chosen")


FOLDS = f"""
WITH l AS ({LABELS}), f AS (SELECT l.*, CAST(v.fold AS INT) AS fold, CASE WHEN {{y}} < v.fold - 1 THEN 'TRAIN' WHEN {{y}} = v.fold - 1 THEN 'CAL' WHEN {{y}} = v.fold THEN 'TEST' END AS r0 FROM l{{j}}, (VALUES (1998), (1999), (2000)) v(fold)),
b AS (SELECT fold, min(day) FILTER (r0 = 'CAL') AS cal, min(day) FILTER (r0 = 'TEST') AS test FROM f GROUP BY fold),
w AS (SELECT f.*, CASE WHEN r0 = 'TRAIN' AND label_known_at >= coalesce(cal, test) OR r0 = 'CAL' AND label_known_at >= test THEN 'PURGED' ELSE r0 END AS role FROM f JOIN b USING (fold) WHERE r0 IS NOT NULL)
"""
BY_YEAR = FOLDS.replace("{y}", "year(l.day)").replace("{j}", "")


def folds(t: Tables, group: str | None = None) -> DataFrame:
    return ds.walk_forward(labels(t), [1998, 1999, 2000], "day", "label_known_at", group)


@query("d5_walk_forward", BY_YEAR + "SELECT series_id, day, fold, role FROM w")
def d5(t: Tables) -> DataFrame:
    return folds(t).select("series_id", "day", "fold", "role")


@query("d6_grouped_split", FOLDS.replace("{y}", "year(g.first)").replace("{j}", " JOIN (SELECT series_id, min(day) AS first FROM l GROUP BY ALL) g ON g.series_id = l.series_id") + "SELECT fold, role, count(DISTINCT series_id) AS groups, count(*) AS n FROM w GROUP BY ALL")
def d6(t: Tables) -> DataFrame:
    return folds(t, "series_id").groupBy("fold", "role").agg(F.count_distinct("series_id").alias("groups"), F.count(F.lit(1)).alias("n"))


@query("d7_final_split", "SELECT series_id, week, CASE WHEN week < DATE '1999-01-01' THEN 'DEVELOPMENT' WHEN week >= DATE '1999-07-01' THEN 'FINAL' ELSE 'GAP' END AS split FROM v_weekly")
def d7(t: Tables) -> DataFrame:
    return ds.final_split(t.weekly, "week", "1999-01-01", "1999-07-01").select("series_id", "week", "split")


@query("d8_fold_audit", BY_YEAR + "SELECT fold, role, count(*) AS n, min(day) AS first_decision, max(day) AS last_decision FROM w GROUP BY ALL")
def d8(t: Tables) -> DataFrame:
    return ds.fold_audit(folds(t), "day")


@query("d9_audit_leakage", "SELECT s.series_id, s.day, p.obs_date, CASE WHEN p.available_at > s.day THEN 'NOT_AVAILABLE' WHEN p.obs_date >= s.day THEN 'AFTER_TARGET_START' END AS code FROM v_spine s JOIN v_daily p ON p.series_id = s.series_id AND CAST(date_trunc('month', p.obs_date) AS DATE) = s.day WHERE p.available_at > s.day OR p.obs_date >= s.day")
def d9(t: Tables) -> DataFrame:
    snaps = t.spine.withColumn("decision", F.col("day")).withColumn("target_start", F.col("day"))
    prov = t.daily.select("series_id", F.trunc("obs_date", "month").alias("day"), "obs_date", "available_at", F.col("value").alias("feature_value"), F.col("value").alias("source_value"))
    return ds.audit_leakage(snaps, prov, ["series_id", "day"]).select("series_id", "day", "obs_date", "code")


@query("d10_provenance", "SELECT s.series_id, s.day, p.obs_date, max({'a': p.available_at, 'v': p.value}).a AS available_at FROM v_spine s JOIN v_pit p ON p.series_id = s.series_id AND p.available_at <= s.day AND p.obs_date BETWEEN s.day - 21 AND s.day - 1 GROUP BY ALL")
def d10(t: Tables) -> DataFrame:
    from ..operators.asof import pit_candidates

    return pit_candidates(t.spine, t.pit, KEY, (21, 1)).select("series_id", "day", "obs_date", "available_at")


@query("d11_clear_features", "SELECT series_id, week, CASE WHEN available_at <= week + 700 THEN round(value, 8) END AS value FROM v_weekly")
def d11(t: Tables) -> DataFrame:
    from ..operators.quality import mask_unavailable

    rows = t.weekly.withColumn("value", F.round("value", 8)).withColumn("cutoff", F.date_add("week", 700))
    return mask_unavailable(rows, ["value"], "available_at", "cutoff").select("series_id", "week", "value")


@query("d12_non_overlapping", """
WITH RECURSIVE d AS (SELECT series_id, obs_date AS s, obs_date + 28 AS e FROM v_daily), r(series_id, s, e) AS (
  SELECT series_id, min(s), min(s) + 28 FROM d GROUP BY ALL
  UNION ALL SELECT r.series_id, (SELECT min(d.s) FROM d WHERE d.series_id = r.series_id AND d.s > r.e), (SELECT min(d.s) FROM d WHERE d.series_id = r.series_id AND d.s > r.e) + 28 FROM r WHERE r.s IS NOT NULL
) SELECT series_id, s AS obs_date FROM r WHERE s IS NOT NULL
""")
def d12(t: Tables) -> DataFrame:
    rows = t.daily.select("series_id", "obs_date", F.date_add("obs_date", 28).alias("target_end"))
    return ds.non_overlapping(rows, KEY, "obs_date", "target_end")


@query("d13_strata", "SELECT obs_date, isodow(obs_date) = 1 AS is_monday, CASE WHEN CAST(date_trunc('week', obs_date) AS DATE) + 7 - obs_date IN (1, 3, 5, 7) THEN CAST(CAST(date_trunc('week', obs_date) AS DATE) + 7 - obs_date AS INT) END AS distance FROM v_two")
def d13(t: Tables) -> DataFrame:
    from .registry import week_start

    rows = t.two.withColumn("next_monday", F.date_add(week_start("obs_date"), 7))
    return ds.strata(rows, "obs_date", "next_monday", [1, 3, 5, 7]).select("obs_date", "is_monday", "distance")


@query("d14_poison", "SELECT series_id, day, 0 AS changed FROM v_spine WHERE day <= DATE '1998-01-01'")
def d14(t: Tables) -> DataFrame:
    from ..operators.asof import pit_latest

    late = t.pit.withColumn("value", F.when(F.col("available_at") > "1998-01-01", F.col("value") * 7).otherwise(F.col("value")))
    spine = t.spine.where("day <= date'1998-01-01'")
    a, b = pit_latest(spine, t.pit, KEY, 30), pit_latest(spine, late, KEY, 30)
    both = a.join(b.select("series_id", "day", F.col("known_value").alias("other")), ["series_id", "day"])
    return both.select("series_id", "day", (~F.col("known_value").eqNullSafe(F.col("other"))).cast("int").alias("changed"))


TREND = """
WITH l AS (SELECT obs_date AS day, (a + b) / 2 AS level FROM v_two WHERE a IS NOT NULL AND b IS NOT NULL),
{anchors}
SELECT l.day, l.level / x1.level - 1 AS change1, l.level / x3.level - 1 AS change3, l.level / x7.level - 1 AS change7 FROM l LEFT JOIN x1 ON x1.day = l.day LEFT JOIN x3 ON x3.day = l.day LEFT JOIN x7 ON x7.day = l.day
""".format(anchors=", ".join(f"x{k} AS (SELECT l.day, CASE WHEN (l.day - {k}) - r.day <= 3 THEN r.level END AS level FROM l ASOF LEFT JOIN l r ON l.day - {k} >= r.day)" for k in (1, 3, 7)))
TREND_CASE = "CASE WHEN change1 IS NULL OR change7 IS NULL THEN NULL WHEN change7 > 0.02 AND change1 > -0.01 THEN 'UP' WHEN change7 < -0.02 AND change1 < 0.01 THEN 'DOWN' ELSE 'SIDEWAYS' END"


@query("d15_trend_rule", f"SELECT day AS obs_date, round(change1, 6) AS change1, round(change3, 6) AS change3, round(change7, 6) AS change7, {TREND_CASE} AS trend FROM ({TREND})")
def d15(t: Tables) -> DataFrame:
    got = ds.trend_rule(t.two, "obs_date", "a", "b")
    return got.withColumns({c: F.round(c, 6) for c in ("change1", "change3", "change7")})


@query("d16_trend_sanity", f"SELECT count(trend) AS windows, count(*) FILTER (trend = 'UP' AND change7 < 0 OR trend = 'DOWN' AND change7 > 0) AS contradictions, count(*) FILTER (change7 < -0.05 AND change1 < -0.02 AND trend <> 'DOWN') AS missed_falls FROM (SELECT *, {TREND_CASE} AS trend FROM ({TREND}))")
def d16(t: Tables) -> DataFrame:
    got, c7 = ds.trend_rule(t.two, "obs_date", "a", "b"), F.col("change7")
    wrong = (F.col("trend") == "UP") & (c7 < 0) | (F.col("trend") == "DOWN") & (c7 > 0)
    return got.agg(F.count("trend").alias("windows"), F.count_if(wrong).alias("contradictions"), F.count_if((c7 < -0.05) & (F.col("change1") < -0.02) & (F.col("trend") != "DOWN")).alias("missed_falls"))


@query("d17_freshness", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'UNAVAILABLE' WHEN ts + INTERVAL 3 DAY < TIMESTAMP '2024-01-05' THEN 'STALE' ELSE 'LIVE' END AS freshness, CASE WHEN event_type = 'error' THEN 'NEVER_CHECKED' WHEN ts > TIMESTAMP '2024-01-05' THEN 'CHECKED_IN_FUTURE' WHEN ts + INTERVAL 3 DAY < TIMESTAMP '2024-01-05' THEN 'EXPIRED' END AS freshness_reason FROM events")
def d17(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    checked = F.when(F.col("event_type") != "error", ts)
    got = ds.freshness(t["events"], checked, ts + F.expr("INTERVAL 3 DAYS"), F.lit("2024-01-05").cast("timestamp"))
    return got.select("event_id", "freshness", "freshness_reason")
