"""Queries of the joins (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof
from .registry import Tables, query


@query("j1_join_series", "SELECT a.obs_date, round(a.value, 8) AS value_a, round(b.value, 8) AS value_b FROM v_daily a JOIN v_daily b ON a.obs_date = b.obs_date WHERE a.series_id = '1-URGENT' AND b.series_id = '5-LOW'")
def j1(t: Tables) -> DataFrame:
    one = lambda s, n: t.daily.where(F.col("series_id") == s).select("obs_date", F.round("value", 8).alias(n))
    return one("1-URGENT", "value_a").join(one("5-LOW", "value_b"), "obs_date")


@query("j2_align_calendar", "SELECT CAST(d AS DATE) AS day, round(a, 8) AS a, round(b, 8) AS b FROM (SELECT unnest(generate_series(min(obs_date), max(obs_date), INTERVAL 1 DAY)) AS d FROM v_two) LEFT JOIN v_two ON obs_date = CAST(d AS DATE)")
def j2(t: Tables) -> DataFrame:
    days = t.two.agg(F.min("obs_date").alias("lo"), F.max("obs_date").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(t.two, days["day"] == t.two["obs_date"], "left").select("day", F.round("a", 8).alias("a"), F.round("b", 8).alias("b"))


@query("j3_asof_backward", """
SELECT s.series_id, s.day, CASE WHEN s.day - d.obs_date <= 7 THEN d.obs_date END AS seen_date, CASE WHEN s.day - d.obs_date <= 7 THEN round(d.value, 8) END AS seen_value
FROM v_spine s ASOF LEFT JOIN v_daily d ON s.series_id = d.series_id AND s.day >= d.obs_date
""")
def j3(t: Tables) -> DataFrame:
    right = t.daily.select("series_id", "obs_date", F.col("obs_date").alias("seen_date"), F.round("value", 8).alias("seen_value"))
    return asof.asof_join(t.spine, right, ["series_id"], "day", "obs_date", ["seen_date", "seen_value"], 7)


@query("j4_asof_forward", """
SELECT s.series_id, s.day, CASE WHEN d.obs_date - (s.day + 7) <= 4 THEN d.obs_date END AS end_date, CASE WHEN d.obs_date - (s.day + 7) <= 4 THEN round(d.value, 8) END AS end_value
FROM v_spine s ASOF LEFT JOIN v_daily d ON s.series_id = d.series_id AND s.day + 7 <= d.obs_date
""")
def j4(t: Tables) -> DataFrame:
    right = t.daily.select("series_id", "obs_date", F.col("obs_date").alias("end_date"), F.round("value", 8).alias("end_value"))
    left = t.spine.withColumn("target", F.date_add("day", 7))
    return asof.asof_join(left, right, ["series_id"], "target", "obs_date", ["end_date", "end_value"], 4, forward=True).drop("target")


PIT_LATEST = """
SELECT s.series_id, s.day, r.obs AS known_obs, r.known AS known_at, r.value AS known_value FROM v_spine s LEFT JOIN (
  SELECT s.series_id, s.day, max({'obs': p.obs_date, 'known': p.available_at, 'value': p.value}) AS r FROM v_spine s JOIN v_pit p
  ON s.series_id = p.series_id AND p.available_at <= s.day AND p.obs_date >= s.day - 30 GROUP BY ALL) x ON s.series_id = x.series_id AND s.day = x.day
"""


@query("j5_pit_latest", PIT_LATEST)
def j5(t: Tables) -> DataFrame:
    return asof.pit_latest(t.spine, t.pit, ["series_id"], 30)


@query("j6_pit_anchor", f"""
WITH now AS ({PIT_LATEST}), c AS (
  SELECT n.series_id, n.day, p.obs_date, max_by(p.value, {{'a': p.available_at, 'v': p.value}}) AS value FROM now n JOIN v_pit p ON n.series_id = p.series_id AND p.available_at <= n.day
  AND p.obs_date BETWEEN n.known_obs - 14 AND n.known_obs - 7 GROUP BY ALL)
SELECT n.*, a.obs_date AS anchor_obs, a.value AS anchor_value FROM now n LEFT JOIN (SELECT series_id, day, max(obs_date) AS obs_date, max_by(value, obs_date) AS value FROM c GROUP BY ALL) a ON n.series_id = a.series_id AND n.day = a.day
""")
def j6(t: Tables) -> DataFrame:
    return asof.pit_anchor(t.spine, t.pit, ["series_id"], 7, 7, 30)


@query("j7_pit_tail", """
WITH c AS (SELECT s.series_id, s.day, p.obs_date, max_by(p.value, {'a': p.available_at, 'v': p.value}) AS value FROM v_spine s JOIN v_pit p ON s.series_id = p.series_id AND p.available_at <= s.day AND p.obs_date BETWEEN s.day - 84 AND s.day - 1 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY obs_date DESC) AS n FROM c QUALIFY n <= 21),
g AS (SELECT *, obs_date - lag(obs_date) OVER (PARTITION BY series_id, day ORDER BY obs_date) AS step FROM k)
SELECT series_id, day, count(*) AS n, min(obs_date) AS first_obs, max(obs_date) AS last_obs, round(avg(value), 8) AS mean_value, CAST(coalesce(max(step), 0) AS INT) AS widest_gap, count(*) = 21 AND coalesce(max(step), 0) <= 4 AS usable FROM g GROUP BY ALL
""")
def j7(t: Tables) -> DataFrame:
    tail = asof.pit_tail(t.spine, t.pit, ["series_id"], 21, 4)
    return tail.withColumn("mean_value", F.round("mean_value", 8)).withColumn("usable", (F.col("n") == 21) & (F.col("widest_gap") <= 4))


@query("j8_asof_report", """
WITH r AS (SELECT available_at, max({'a': available_at, 'o': obs_date, 'v': value}) AS r FROM v_pit GROUP BY ALL)
SELECT c.cycle_date, CASE WHEN c.cycle_date - x.available_at <= 21 THEN x.r.o END AS report_date, CASE WHEN c.cycle_date - x.available_at <= 21 THEN x.r.v END AS report_value FROM v_cycles c ASOF LEFT JOIN r x ON c.cycle_date >= x.available_at
""")
def j8(t: Tables) -> DataFrame:
    reports = t.pit.select(F.lit(0).alias("one"), "available_at", F.col("obs_date").alias("report_date"), F.col("value").alias("report_value"))
    return asof.asof_join(t.cycles.withColumn("one", F.lit(0)), reports, ["one"], "cycle_date", "available_at", ["report_date", "report_value"], 21).drop("one")


@query("j9_cycle_of", """
WITH d AS (SELECT DISTINCT obs_date AS day FROM v_daily)
SELECT day, p.cycle_date AS previous_cycle, n.cycle_date AS next_cycle, CAST(n.cycle_date - p.cycle_date AS INT) AS gap_days, coalesce(n.cycle_date - p.cycle_date > 30, true) AS excluded
FROM (SELECT d.day, a.cycle_date FROM d ASOF LEFT JOIN v_cycles a ON d.day >= a.cycle_date) p JOIN (SELECT d.day, a.cycle_date FROM d ASOF LEFT JOIN v_cycles a ON d.day < a.cycle_date) n USING (day)
""")
def j9(t: Tables) -> DataFrame:
    days = t.daily.select(F.lit(0).alias("one"), F.col("obs_date").alias("day"), F.date_add("obs_date", 1).alias("after")).distinct()
    events = t.cycles.select(F.lit(0).alias("one"), "cycle_date", F.col("cycle_date").alias("previous_cycle"), F.col("cycle_date").alias("next_cycle"))
    both = asof.asof_join(days, events, ["one"], "day", "cycle_date", ["previous_cycle"], 60)
    both = asof.asof_join(both, events, ["one"], "after", "cycle_date", ["next_cycle"], 60, forward=True)
    gap = F.datediff("next_cycle", "previous_cycle")
    return both.select("day", "previous_cycle", "next_cycle", gap.alias("gap_days"), F.coalesce(gap > 30, F.lit(True)).alias("excluded"))


@query("j10_seasonal_peers", """
WITH w AS (SELECT series_id, CAST(isoyear(week) AS INT) AS y, CAST(weekofyear(week) AS INT) AS w, value FROM v_weekly)
SELECT a.series_id, a.y, a.w, count(*) AS peers, round(avg(b.value), 8) AS peer_mean FROM w a JOIN w b ON a.series_id = b.series_id AND b.y BETWEEN a.y - 5 AND a.y - 1 AND least(abs(a.w - b.w), 53 - abs(a.w - b.w)) <= 3 GROUP BY ALL
""")
def j10(t: Tables) -> DataFrame:
    weeks = t.weekly.select("series_id", F.extract(F.lit("YEAROFWEEK"), "week").alias("y"), F.weekofyear("week").alias("w"), "value")
    return asof.seasonal_peers(weeks, ["series_id"], "y", "w", "value").groupBy("series_id", "y", "w").agg(F.count(F.lit(1)).alias("peers"), F.round(F.avg("peer_value"), 8).alias("peer_mean"))


@query("j11_lag_join", "SELECT x.week, CAST(k.lag AS INT) AS lag, round(x.a, 8) AS a, round(y.b, 8) AS b FROM v_two_weekly x, (VALUES (-1), (0), (1)) k(lag), v_two_weekly y WHERE y.week = x.week + CAST(k.lag * 7 AS INT)")
def j11(t: Tables) -> DataFrame:
    a, b = t.two_weekly.select("week", F.round("a", 8).alias("a")), t.two_weekly.select("week", F.round("b", 8).alias("b"))
    return asof.lag_join(a, b, "week", [-1, 0, 1])


@query("j12_calendar_lag", "SELECT p.week, p.open_interest, q.open_interest AS open_interest_lag4 FROM v_positions p LEFT JOIN v_positions q ON q.week = p.week - 28")
def j12(t: Tables) -> DataFrame:
    return asof.calendar_lag(t.positions.select("week", "open_interest"), [], "week", ["open_interest"], 4)


@query("j13_config_grid", "SELECT r_name AS grp, s.mktsegment AS family, CAST(k.c AS INT) AS calibrator FROM region, (SELECT DISTINCT c_mktsegment AS mktsegment FROM customer) s, (VALUES (0), (1)) k(c)")
def j13(t: Tables) -> DataFrame:
    calibrators = t.spark.range(2).select(F.col("id").cast("int").alias("calibrator"))
    return asof.grid(group=t["region"].select(F.col("r_name").alias("grp")), family=t["customer"].select(F.col("c_mktsegment").alias("family")).distinct(), calibrator=calibrators)


@query("j14_exclude_seen", "SELECT id, event_key FROM v_signals s WHERE event_date >= DATE '2024-01-02' AND NOT EXISTS (SELECT 1 FROM v_signals o WHERE o.event_key = s.event_key AND o.measurement_key = s.measurement_key AND o.event_date < DATE '2024-01-02' AND o.structured)")
def j14(t: Tables) -> DataFrame:
    seen = t.signals.where("event_date < date'2024-01-02' and structured").select("event_key", "measurement_key")
    return t.signals.where("event_date >= date'2024-01-02'").join(seen, ["event_key", "measurement_key"], "left_anti").select("id", "event_key")


@query("j15_enrich", "SELECT s.id, s.source, min(u.c_name) AS first_name FROM v_signals s LEFT JOIN customer u ON u.c_custkey = s.user_id AND u.c_acctbal > 0 GROUP BY ALL")
def j15(t: Tables) -> DataFrame:
    names = t["customer"].where("c_acctbal > 0").groupBy(F.col("c_custkey").alias("user_id")).agg(F.min("c_name").alias("first_name"))
    return t.signals.join(names, "user_id", "left").select("id", "source", "first_name")


@query("j16_resolve_outcomes", """
SELECT s.series_id, s.day AS made, s.day + 7 AS due_date, CASE WHEN d.obs_date - (s.day + 7) <= 4 THEN d.obs_date END AS outcome_date, CASE WHEN d.obs_date - (s.day + 7) <= 4 THEN round(d.value, 8) END AS outcome_value
FROM v_spine s ASOF LEFT JOIN v_daily d ON s.series_id = d.series_id AND s.day + 7 <= d.obs_date
""")
def j16(t: Tables) -> DataFrame:
    made = t.spine.withColumnRenamed("day", "made")
    return asof.resolve_outcomes(made, t.daily.withColumn("value", F.round("value", 8)), ["series_id"], "made", "obs_date", "value", 7, 4)


@query("j17_event_conflicts", "SELECT event_key, event_date, count(*) FILTER (direction = 'UP') AS ups, count(*) FILTER (direction = 'DOWN') AS downs FROM v_signals GROUP BY ALL HAVING count(*) FILTER (direction = 'UP') > 0 AND count(*) FILTER (direction = 'DOWN') > 0")
def j17(t: Tables) -> DataFrame:
    ups, downs = F.count_if(F.col("direction") == "UP"), F.count_if(F.col("direction") == "DOWN")
    return t.signals.groupBy("event_key", "event_date").agg(ups.alias("ups"), downs.alias("downs")).where("ups > 0 and downs > 0")


@query("j18_report_week_positions", "SELECT w.series_id, w.week, p.open_interest FROM v_weekly w LEFT JOIN v_positions p ON p.week = w.week - 7")
def j18(t: Tables) -> DataFrame:
    return t.weekly.join(t.positions.select(F.date_add("week", 7).alias("week"), "open_interest"), "week", "left").select("series_id", "week", "open_interest")


