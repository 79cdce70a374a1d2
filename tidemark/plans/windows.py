"""Queries of the window functions and time-series features (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof
from ..operators import windows as win
from .registry import Tables, query

KEY = ["series_id"]
OVER = "OVER (PARTITION BY series_id ORDER BY week)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, k in df.dtypes if k == "double"})


def lag(k: int) -> str:
    return f"lag(value, {k}) {OVER}"


def frame(k: int) -> str:
    return f"OVER (PARTITION BY series_id ORDER BY week ROWS {k - 1} PRECEDING)"


def cols(t: Tables, *names: str) -> DataFrame:
    return t.weekly.select("series_id", "week", "value", *names)


@query("w1_returns", "SELECT series_id, week, " + ", ".join(f"round(ln(value / {lag(k)}), 6) AS r{k}" for k in (1, 2, 4, 8, 13)) + " FROM v_weekly")
def w1(t: Tables) -> DataFrame:
    return rounded(win.returns(cols(t), KEY, "week", "value", [1, 2, 4, 8, 13]).drop("value"))


@query("w2_asinh_difference", f"SELECT series_id, week, round(asinh(value / 50) - asinh({lag(1)} / 50), 6) AS r1 FROM v_weekly")
def w2(t: Tables) -> DataFrame:
    return rounded(win.returns(cols(t), KEY, "week", "value", [1], kind="asinh").drop("value"))


@query("w3_rolling_std", "WITH r AS (SELECT series_id, week, ln(value / " + lag(1) + ") AS r1 FROM v_weekly) SELECT series_id, week, " + ", ".join(f"CASE WHEN count(r1) {frame(k)} = {k} THEN round(stddev_samp(r1) {frame(k)}, 6) END AS std{k}" for k in (4, 13, 26)) + " FROM r")
def w3(t: Tables) -> DataFrame:
    r = win.returns(cols(t), KEY, "week", "value", [1])
    return rounded(win.rolling(r, KEY, "week", "r1", [4, 13, 26], "std").drop("value", "r1"))


@query("w4_calendar_std", """
WITH r AS (SELECT series_id, obs_date, value, value - lag(value) OVER (PARTITION BY series_id ORDER BY obs_date) AS d FROM v_daily),
x AS (SELECT a.series_id, a.obs_date, b.d, row_number() OVER (PARTITION BY a.series_id, a.obs_date ORDER BY b.obs_date) AS n FROM r a JOIN r b ON a.series_id = b.series_id AND b.obs_date BETWEEN a.obs_date - 20 AND a.obs_date)
SELECT series_id, obs_date, CASE WHEN count(*) >= 8 THEN round(stddev_samp(d) FILTER (n > 1), 3) END AS std_days FROM x GROUP BY ALL
""")
def w4(t: Tables) -> DataFrame:
    return rounded(win.rolling_std_days(t.daily.select("series_id", "obs_date", "value"), KEY, "obs_date", "value", 21, 8).drop("value"), 3)


@query("w5_ma_distance", "SELECT series_id, week, " + ", ".join(f"CASE WHEN count(value) {frame(k)} = {k} THEN round(value / avg(value) {frame(k)} - 1, 6) END AS ma_distance{k}" for k in (4, 13, 26)) + " FROM v_weekly")
def w5(t: Tables) -> DataFrame:
    return rounded(win.rolling(cols(t), KEY, "week", "value", [4, 13, 26], "ma_distance").drop("value"))


@query("w6_drawdown", "SELECT series_id, week, round(value / max(value) OVER (PARTITION BY series_id ORDER BY week ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM v_weekly")
def w6(t: Tables) -> DataFrame:
    return rounded(win.drawdown(cols(t), KEY, "week", "value").drop("value"))


@query("w7_momentum", f"SELECT series_id, week, round(ln(value / {lag(4)}) / 4 - ln(value / {lag(13)}) / 13, 6) AS momentum, round(-ln(value / {lag(1)}), 6) AS reversal FROM v_weekly")
def w7(t: Tables) -> DataFrame:
    r = win.returns(cols(t), KEY, "week", "value", [1, 4, 13])
    return rounded(win.momentum(r, "r4", 4, "r13", 13, "r1").select("series_id", "week", "momentum", "reversal"))


@query("w8_spread", "WITH s AS (SELECT week, a * 42 - b AS spread FROM v_two_weekly) SELECT week, round(spread, 7) AS spread, round(spread - lag(spread, 5) OVER (ORDER BY week), 7) AS change5, CASE WHEN count(*) OVER (ORDER BY week ROWS 19 PRECEDING) = 20 THEN round(spread / avg(spread) OVER (ORDER BY week ROWS 19 PRECEDING) - 1, 6) END AS distance20 FROM s")
def w8(t: Tables) -> DataFrame:
    s = t.two_weekly.select(F.lit(0).alias("one"), "week", (F.col("a") * 42 - F.col("b")).alias("spread"))
    s = win.rolling(s, ["one"], "week", "spread", [20], "ma_distance")
    s = s.join(s.select(F.col("week"), F.lag("spread", 5).over(win._w(["one"], "week")).alias("_old")), "week")
    return s.select("week", F.round("spread", 7).alias("spread"), F.round(F.col("spread") - F.col("_old"), 7).alias("change5"), F.round("ma_distance20", 6).alias("distance20"))


@query("w9_region_features", "WITH r AS (SELECT week, ln(a / lag(a) OVER (ORDER BY week)) AS a, ln(b / lag(b) OVER (ORDER BY week)) AS b FROM v_two_weekly) SELECT week, round(a - b, 6) AS divergence, round(abs(a - b) / 2, 6) AS dispersion, sign(a) = sign(b) AS agree FROM r")
def w9(t: Tables) -> DataFrame:
    two = t.two_weekly.withColumn("one", F.lit(0))
    r = win.returns(win.returns(two, ["one"], "week", "a", [1]).withColumnRenamed("r1", "ra"), ["one"], "week", "b", [1])
    d = F.col("ra") - F.col("r1")
    return r.select("week", F.round(d, 6).alias("divergence"), F.round(F.abs(d) / 2, 6).alias("dispersion"), (F.sign("ra") == F.sign("r1")).alias("agree"))


@query("w10_rolling_corr", "SELECT week, CASE WHEN count(*) OVER (ORDER BY week ROWS 51 PRECEDING) = 52 THEN round(corr(a, b) OVER (ORDER BY week ROWS 51 PRECEDING), 6) END AS rolling_corr FROM v_two_weekly")
def w10(t: Tables) -> DataFrame:
    return rounded(win.rolling_corr(t.two_weekly.withColumn("one", F.lit(0)), ["one"], "week", "a", "b", 52).select("week", "rolling_corr"))


def _percentile(less: str) -> str:
    return f"SELECT n.series_id, n.week, count(o.week) AS earlier, round(count(*) FILTER (o.value {less} n.value) / nullif(count(o.week), 0), 9) AS percentile FROM v_weekly n LEFT JOIN v_weekly o ON o.series_id = n.series_id AND o.week < n.week GROUP BY n.series_id, n.week, n.value"


@query("w11_expanding_percentile", _percentile("<"))
def w11(t: Tables) -> DataFrame:
    return rounded(win.expanding_percentile(cols(t), KEY, "week", "value").drop("value"), 9)


@query("w11b_expanding_percentile_inclusive", _percentile("<="))
def w11b(t: Tables) -> DataFrame:
    return rounded(win.expanding_percentile(cols(t), KEY, "week", "value", strict=False).drop("value"), 9)


STATE = "CASE WHEN p > 2.0 / 3 THEN 'STRONG' WHEN p < 1.0 / 3 THEN 'WEAK' WHEN p IS NOT NULL THEN 'NEUTRAL' END"


@query("w12_current_state", f"WITH h AS (SELECT series_id, week, value, list(value) {frame(20)} AS h FROM v_weekly), p AS (SELECT series_id, week, CASE WHEN len(h) = 20 THEN len(list_filter(h, lambda x: x <= value)) / 20 END AS p FROM h) SELECT series_id, week, round(p, 6) AS trailing_percentile, {STATE} AS state FROM p")
def w12(t: Tables) -> DataFrame:
    return rounded(win.trailing_state(cols(t), KEY, "week", "value", 20).drop("value"))


@query("w13_composite_state", f"WITH h AS (SELECT series_id, week, value, list(value) {frame(20)} AS h FROM v_weekly), s AS (SELECT series_id, week, CASE WHEN len(h) = 20 THEN len(list_filter(h, lambda x: x <= value)) / 20 END AS p FROM h), p AS (SELECT week, median(p) AS p FROM s GROUP BY ALL) SELECT week, round(p, 6) AS p, {STATE} AS state FROM p")
def w13(t: Tables) -> DataFrame:
    each = win.trailing_state(cols(t), KEY, "week", "value", 20).groupBy("week").agg(F.median("trailing_percentile").alias("p"))
    return each.select("week", F.round("p", 6).alias("p"), win.state_of(F.col("p")).alias("state"))


@query("w14_lead_target", f"WITH r AS (SELECT series_id, week, ln(value / {lag(1)}) AS r1 FROM v_weekly) SELECT series_id, week, CASE WHEN lead(week) {OVER} - week = 7 THEN round(lead(r1) {OVER}, 6) END AS target FROM r")
def w14(t: Tables) -> DataFrame:
    r = win.returns(cols(t), KEY, "week", "value", [1])
    return rounded(win.lead_target(r, KEY, "week", "r1").select("series_id", "week", "target"))


def _lagged(k: int) -> str:
    return f"SELECT series_id, week, round({lag(k)}, 8) AS value_lag, max(available_at) OVER (PARTITION BY series_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND {k} PRECEDING) AS available_at_lag FROM v_weekly"


@query("w15_lag_features", _lagged(1))
def w15(t: Tables) -> DataFrame:
    return rounded(win.lag_features(cols(t, "available_at"), KEY, "week", ["value"], "available_at", 1).drop("value", "available_at"), 8)


@query("w16_delay_sensitivity", _lagged(2))
def w16(t: Tables) -> DataFrame:
    return rounded(win.lag_features(cols(t, "available_at"), KEY, "week", ["value"], "available_at", 2).drop("value", "available_at"), 8)


@query("w17_segments", "WITH g AS (SELECT user_id, day, CAST(day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS INT) AS gap_days FROM (SELECT DISTINCT user_id, event_date AS day FROM v_signals)) SELECT user_id, day, gap_days, CAST(sum(CASE WHEN gap_days > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g")
def w17(t: Tables) -> DataFrame:
    days = t.signals.select("user_id", F.col("event_date").alias("day")).distinct()
    return win.segment_by_gap(days, ["user_id"], "day", 2)


@query("w18_composite_return", "WITH r AS (SELECT week, ln(a / lag(a) OVER (ORDER BY week)) AS a, ln(b / lag(b) OVER (ORDER BY week)) AS b FROM v_two_weekly) SELECT week, round(0.5 * a + 0.5 * b, 6) AS composite FROM r")
def w18(t: Tables) -> DataFrame:
    two = t.two_weekly.withColumn("one", F.lit(0))
    r = win.returns(win.returns(two, ["one"], "week", "a", [1]).withColumnRenamed("r1", "ra"), ["one"], "week", "b", [1])
    return r.select("week", F.round(0.5 * F.col("ra") + 0.5 * F.col("r1"), 6).alias("composite"))


@query("w19_chain_level", """
WITH ok AS (SELECT * FROM v_panel WHERE value > 0), valid AS (SELECT week, lag(week) OVER (ORDER BY week) AS before FROM (SELECT week FROM ok GROUP BY week HAVING count(*) >= 20)),
m AS (SELECT n.week, median(ln(n.value / o.value)) AS r, count(*) AS matched FROM ok n JOIN valid v ON n.week = v.week JOIN ok o ON o.entity = n.entity AND o.week = v.before GROUP BY n.week)
SELECT v.week, coalesce(m.matched, 0) AS matched, round(100 * exp(sum(CASE WHEN m.matched >= 20 THEN m.r ELSE 0 END) OVER (ORDER BY v.week)), 4) AS level FROM valid v LEFT JOIN m ON m.week = v.week
""")
def w19(t: Tables) -> DataFrame:
    return rounded(win.chain_level(t.panel, "entity", "week", "value", 20), 4)


@query("w20_season", "SELECT DISTINCT week, round(sin(2 * pi() * weekofyear(week) / 52.1775), 6) AS season_sin, round(cos(2 * pi() * weekofyear(week) / 52.1775), 6) AS season_cos FROM v_weekly")
def w20(t: Tables) -> DataFrame:
    return rounded(win.season(t.weekly.select("week").distinct(), "week"))


@query("w21_candidate_rank", "SELECT model, year, CAST(row_number() OVER (PARTITION BY year ORDER BY round(avg(p_up), 9), model) AS INT) AS rank FROM v_probs GROUP BY model, year")
def w21(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    means = t.probs.groupBy("model", "year").agg(F.round(F.avg("p_up"), 9).alias("m"))
    return means.select("model", "year", F.row_number().over(Window.partitionBy("year").orderBy("m", "model")).alias("rank"))


@query("w22_position_features", """
SELECT p.week, round((p.long_qty - p.short_qty) / p.open_interest, 6) AS net_share, round((p.long_qty - p.short_qty) / p.open_interest - (q.long_qty - q.short_qty) / q.open_interest, 6) AS net_change1,
round((p.long_qty - p.short_qty) / p.open_interest - (r.long_qty - r.short_qty) / r.open_interest, 6) AS net_change4, round(p.open_interest / q.open_interest - 1, 6) AS oi_change1, round((p.long_qty + p.short_qty) / p.open_interest, 6) AS gross_share
FROM v_positions p LEFT JOIN v_positions q ON q.week = p.week - 7 LEFT JOIN v_positions r ON r.week = p.week - 28
""")
def w22(t: Tables) -> DataFrame:
    p = t.positions.withColumn("net_share", (F.col("long_qty") - F.col("short_qty")) / F.col("open_interest")).withColumn("gross_share", (F.col("long_qty") + F.col("short_qty")) / F.col("open_interest"))
    p = asof.calendar_lag(asof.calendar_lag(p, [], "week", ["net_share", "open_interest"], 1), [], "week", ["net_share"], 4)
    out = p.select("week", "net_share", (F.col("net_share") - F.col("net_share_lag1")).alias("net_change1"), (F.col("net_share") - F.col("net_share_lag4")).alias("net_change4"), (F.col("open_interest") / F.col("open_interest_lag1") - 1).alias("oi_change1"), "gross_share")
    return rounded(out)


@query("w23_inventory_features", "SELECT p.week, p.spread_qty - q.spread_qty AS delta1, p.spread_qty - r.spread_qty AS delta4, round((p.spread_qty - q.spread_qty) / q.spread_qty, 6) AS pct1 FROM v_positions p LEFT JOIN v_positions q ON q.week = p.week - 7 LEFT JOIN v_positions r ON r.week = p.week - 28")
def w23(t: Tables) -> DataFrame:
    p = asof.calendar_lag(asof.calendar_lag(t.positions.select("week", "spread_qty"), [], "week", ["spread_qty"], 1), [], "week", ["spread_qty"], 4)
    now, one, four = F.col("spread_qty"), F.col("spread_qty_lag1"), F.col("spread_qty_lag4")
    return p.select("week", (now - one).alias("delta1"), (now - four).alias("delta4"), F.round(F.when(one != 0, (now - one) / one), 6).alias("pct1"))


@query("w24_seasonal_zscore", """
WITH w AS (SELECT series_id, week, CAST(isoyear(week) AS INT) AS y, CAST(weekofyear(week) AS INT) AS w, value FROM v_weekly),
p AS (SELECT a.series_id, a.week, a.value, count(*) AS peers, avg(b.value) AS m, stddev_samp(b.value) AS s FROM w a JOIN w b ON a.series_id = b.series_id AND b.y BETWEEN a.y - 5 AND a.y - 1 AND least(abs(a.w - b.w), 53 - abs(a.w - b.w)) <= 3 GROUP BY ALL)
SELECT series_id, week, peers, CASE WHEN peers >= 10 AND s > 0 THEN round((value - m) / s, 6) END AS zscore FROM p
""")
def w24(t: Tables) -> DataFrame:
    weeks = t.weekly.select("series_id", "week", F.extract(F.lit("YEAROFWEEK"), "week").alias("y"), F.weekofyear("week").alias("w"), "value")
    stats = asof.seasonal_peers(weeks, KEY, "y", "w", "value").groupBy("series_id", "y", "w").agg(F.count(F.lit(1)).alias("peers"), F.avg("peer_value").alias("m"), F.stddev_samp("peer_value").alias("s"))
    z = F.when((F.col("peers") >= 10) & (F.col("s") > 0), (F.col("value") - F.col("m")) / F.col("s"))
    return weeks.join(stats, ["series_id", "y", "w"]).select("series_id", "week", "peers", F.round(z, 6).alias("zscore"))


@query("w25_propagate_availability", f"SELECT series_id, week, greatest(available_at, coalesce(lag(available_at, 1) {OVER}, available_at), coalesce(lag(available_at, 4) {OVER}, available_at)) AS feature_available_at FROM v_weekly")
def w25(t: Tables) -> DataFrame:
    w = win._w(KEY, "week")
    return t.weekly.select("series_id", "week", F.greatest("available_at", F.lag("available_at", 1).over(w), F.lag("available_at", 4).over(w)).alias("feature_available_at"))
