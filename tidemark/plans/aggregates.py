"""Queries of the aggregations (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import classify
from ..operators import aggregates as agg
from ..operators import ranks
from .registry import Tables, query

TRUTH = ["DOWN", "FLAT", "UP"]


@query("a1_weekly_bars", "SELECT series_id, CAST(date_trunc('week', obs_date) AS DATE) AS week, round(avg(value), 8) AS mean_value, count(*) AS n, max(available_at) AS available_at FROM v_daily WHERE date_trunc('week', obs_date) < (SELECT date_trunc('week', max(obs_date)) FROM v_daily) GROUP BY ALL HAVING count(*) >= 2")
def a1(t: Tables) -> DataFrame:
    return agg.weekly_bars(t.daily, ["series_id"], "obs_date", "value", "available_at", min_n=2, drop_last=True).withColumn("mean_value", F.round("mean_value", 8))


@query("a2_friday_weeks", "SELECT series_id, CAST(date_trunc('week', obs_date + 2) AS DATE) + 4 AS week, CASE WHEN count(*) >= 3 THEN round(avg(value), 8) END AS mean_value, count(*) AS n FROM v_daily GROUP BY ALL")
def a2(t: Tables) -> DataFrame:
    return agg.weekly_bars(t.daily, ["series_id"], "obs_date", "value", ends="FRI", min_n=3, null_short=True).withColumn("mean_value", F.round("mean_value", 8))


@query("a3_weekly_fx", "SELECT CAST(date_trunc('week', obs_date) AS DATE) AS week, round(avg(a), 8) AS mean_value, count(a) AS n FROM v_two GROUP BY ALL HAVING count(a) >= 1")
def a3(t: Tables) -> DataFrame:
    return agg.weekly_bars(t.two, [], "obs_date", "a").withColumn("mean_value", F.round("mean_value", 8))


@query("a4_class_shares", "SELECT year, n, n_down, n_flat, n_up, round(least(n_down / n, n_flat / n, n_up / n), 9) AS least_share, round(greatest(n_down / n, n_flat / n, n_up / n), 9) AS greatest_share FROM (SELECT year, count(*) AS n, count(*) FILTER (truth = 'DOWN') AS n_down, count(*) FILTER (truth = 'FLAT') AS n_flat, count(*) FILTER (truth = 'UP') AS n_up FROM v_probs WHERE model = 'm1' GROUP BY year)")
def a4(t: Tables) -> DataFrame:
    out = agg.class_shares(t.probs.where("model = 'm1'"), ["year"], "truth")
    return out.withColumns({c: F.round(c, 9) for c in ("least_share", "greatest_share")})


@query("a5_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS q5, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.95), 6) AS q95 FROM lineitem GROUP BY ALL")
def a5(t: Tables) -> DataFrame:
    return ranks.quantiles(t["lineitem"], ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95]).withColumns({c: F.round(c, 6) for c in ("q5", "q50", "q95")})


@query("a6_matched_median", "SELECT a.week, CASE WHEN count(*) >= 20 THEN round(median(ln(a.value / b.value)), 6) END AS median_return, count(*) AS matched FROM v_panel a JOIN v_panel b ON a.entity = b.entity AND b.week = a.week - 7 WHERE a.value > 0 AND b.value > 0 GROUP BY ALL")
def a6(t: Tables) -> DataFrame:
    return agg.matched_median(t.panel, "entity", "week", "value", 20).withColumn("median_return", F.round("median_return", 6))


@query("a7_pair_metrics", "WITH r AS (SELECT x.week, ln(x.a / y.a) AS a, ln(x.b / y.b) AS b FROM v_two_weekly x JOIN v_two_weekly y ON y.week = x.week - 7) SELECT count(*) AS n, round(corr(a, b), 6) AS correlation, round(avg(CASE WHEN abs(a) > 1e-12 AND abs(b) > 1e-12 THEN CAST(sign(a) = sign(b) AS DOUBLE) END), 6) AS sign_agreement FROM r")
def a7(t: Tables) -> DataFrame:
    from ..operators.asof import calendar_lag

    r = calendar_lag(t.two_weekly, [], "week", ["a", "b"], 1).select(F.log(F.col("a") / F.col("a_lag1")).alias("a"), F.log(F.col("b") / F.col("b_lag1")).alias("b"))
    return agg.pair_metrics(r, [], "a", "b").withColumns({c: F.round(c, 6) for c in ("correlation", "sign_agreement")})


CLASSED = "SELECT *, CASE WHEN p_up > p_down AND p_up > p_flat THEN 'UP' WHEN p_flat > p_down THEN 'FLAT' ELSE 'DOWN' END AS predicted FROM v_probs"


@query("a8_crosstab", f"SELECT t.truth, count(*) FILTER (c.predicted = 'DOWN') AS \"DOWN\", count(*) FILTER (c.predicted = 'FLAT') AS \"FLAT\", count(*) FILTER (c.predicted = 'UP') AS \"UP\" FROM (VALUES ('DOWN'), ('FLAT'), ('UP')) t(truth) LEFT JOIN ({CLASSED}) c ON c.truth = t.truth GROUP BY ALL")
def a8(t: Tables) -> DataFrame:
    from ..functions.probability import argmax_class

    return agg.crosstab(t.probs.withColumn("predicted", argmax_class("p_down", "p_flat", "p_up")), "truth", "predicted", TRUTH)


@query("a9_metrics_by_year", "SELECT model, year, count(*) AS n, round(avg((p_down - CAST(truth = 'DOWN' AS INT)) ** 2 + (p_flat - CAST(truth = 'FLAT' AS INT)) ** 2 + (p_up - CAST(truth = 'UP' AS INT)) ** 2), 6) AS brier FROM v_probs GROUP BY GROUPING SETS ((model, year), (model), ())")
def a9(t: Tables) -> DataFrame:
    from ..operators.scoring import brier_loss

    return t.probs.withColumn("loss", brier_loss()).rollup("model", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("brier"))


@query("a10_block_losses", "SELECT series_id, CAST(floor((obs_date - DATE '1995-01-01') / 28.0) AS BIGINT) AS block, count(*) AS n, round(sum(value), 7) AS total FROM v_daily GROUP BY ALL")
def a10(t: Tables) -> DataFrame:
    return agg.block_sums(t.daily, ["series_id"], "obs_date", 28, "1995-01-01", {"total": F.col("value")}).withColumn("total", F.round("total", 7))


@query("a11_reason_counts", "SELECT CASE WHEN release_date < obs_date THEN 'RELEASE_PRECEDES_OBSERVATION' WHEN value <= 0 THEN 'INVALID_PRICE' ELSE 'OK' END AS reason, count(*) AS n FROM v_vintage GROUP BY ALL")
def a11(t: Tables) -> DataFrame:
    from ..operators.quality import quarantine_reason

    return t.vintage.groupBy(F.coalesce(quarantine_reason(), F.lit("OK")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("a12_independent_sources", "SELECT category, count(DISTINCT source) AS publishers, count(DISTINCT event_key) AS events FROM v_signals GROUP BY ALL")
def a12(t: Tables) -> DataFrame:
    return t.signals.groupBy("category").agg(F.count_distinct("source").alias("publishers"), F.count_distinct("event_key").alias("events"))


@query("a13_collapse_mirrors", "SELECT event_key, event_date, CASE WHEN count(DISTINCT direction) = 1 THEN min(direction) END AS direction, CASE WHEN count(DISTINCT direction) = 1 THEN 'OK' ELSE 'CONFLICT' END AS status, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM v_signals GROUP BY ALL")
def a13(t: Tables) -> DataFrame:
    return agg.collapse_mirrors(t.signals, ["event_key", "event_date"], "direction", "source")


@query("a14_latest", "SELECT user_id, id, event_key FROM v_signals QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY published_at DESC, id DESC) = 1")
def a14(t: Tables) -> DataFrame:
    return agg.latest(t.signals, ["user_id"], ["published_at", "id"], ["id", "event_key"])


@query("a15_lag_stats", "SELECT series_id, CAST(min(release_date - obs_date) AS INT) AS min_days, median(release_date - obs_date) AS median_days, CAST(max(release_date - obs_date) AS INT) AS max_days FROM v_vintage GROUP BY ALL")
def a15(t: Tables) -> DataFrame:
    days = F.datediff("release_date", "obs_date")
    return t.vintage.groupBy("series_id").agg(F.min(days).alias("min_days"), F.median(days).alias("median_days"), F.max(days).alias("max_days"))


@query("a16_event_groups", "SELECT event_key, id, CAST(id = min(id) OVER (PARTITION BY event_key) AS INT) AS vote FROM v_signals")
def a16(t: Tables) -> DataFrame:
    return agg.event_groups(t.signals, "event_key", "id")


@query("a17_representatives", "SELECT direction, event_key, id AS representative FROM v_signals QUALIFY row_number() OVER (PARTITION BY direction, event_key ORDER BY structured DESC, importance DESC, id) = 1")
def a17(t: Tables) -> DataFrame:
    return agg.representatives(t.signals, ["direction", "event_key"], "id", "structured", "importance")


@query("a18_class_of_returns", "WITH r AS (SELECT x.series_id, x.week, ln(x.value / y.value) AS r FROM v_weekly x JOIN v_weekly y ON x.series_id = y.series_id AND y.week = x.week - 7) SELECT series_id, count(*) FILTER (r > 0.02) AS ups, count(*) FILTER (r < -0.02) AS downs, count(*) FILTER (abs(r) <= 0.02) AS flats FROM r GROUP BY ALL")
def a18(t: Tables) -> DataFrame:
    from ..operators.asof import calendar_lag

    c = classify(F.log(F.col("value") / F.col("value_lag1")), 0.02)
    moved = calendar_lag(t.weekly, ["series_id"], "week", ["value"], 1).where("value_lag1 is not null").withColumn("c", c)
    return moved.groupBy("series_id").agg(*[F.count_if(F.col("c") == k).alias(f"{k.lower()}s") for k in ("UP", "DOWN", "FLAT")])
