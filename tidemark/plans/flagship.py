"""The flagship query: from quarantined vintages to scored frequency forecasts, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import classify
from ..operators import asof, scoring
from ..operators.quality import quarantine, quarantine_reason
from .forecast import r9
from .registry import Tables, query

DEADBAND = 0.05
YEARS = [1998, 1999, 2000]
CLASS = f"CASE WHEN {{0}} > {DEADBAND} THEN 'UP' WHEN {{0}} < -{DEADBAND} THEN 'DOWN' WHEN {{0}} IS NOT NULL THEN 'FLAT' END"
LOSS = "(p_down - CAST(truth = 'DOWN' AS INT)) ** 2 + (p_flat - CAST(truth = 'FLAT' AS INT)) ** 2 + (p_up - CAST(truth = 'UP' AS INT)) ** 2"

SQL = f"""
WITH spine AS (SELECT series_id, week, week + 6 AS day FROM v_weekly),
known AS (SELECT s.series_id, s.week, max({{'obs': p.obs_date, 'known': p.available_at, 'value': p.value}}).value AS value FROM spine s JOIN v_pit p ON p.series_id = s.series_id AND p.available_at <= s.day AND p.obs_date >= s.day - 60 GROUP BY ALL),
r AS (SELECT a.series_id, a.week, CAST(year(a.week) AS INT) AS year, ln(a.value / b.value) AS r1, ln(c.value / a.value) AS target FROM known a JOIN known b ON b.series_id = a.series_id AND b.week = a.week - 7 JOIN known c ON c.series_id = a.series_id AND c.week = a.week + 7),
k AS (SELECT *, {CLASS.format('target')} AS truth FROM r),
f AS (SELECT v.y AS fold, k.series_id, (count(*) FILTER (truth = 'DOWN') + 1) / (count(*) + 3) AS p_down, (count(*) FILTER (truth = 'FLAT') + 1) / (count(*) + 3) AS p_flat, (count(*) FILTER (truth = 'UP') + 1) / (count(*) + 3) AS p_up FROM k, (VALUES (1998), (1999), (2000)) v(y) WHERE k.year < v.y AND k.week + 14 < make_date(v.y, 1, 1) GROUP BY ALL),
t AS (SELECT k.year, k.truth, f.* FROM k JOIN f ON f.fold = k.year AND f.series_id = k.series_id)
SELECT year, count(*) AS n, round(avg({LOSS}), 6) AS brier, round(avg(-ln(greatest(CASE truth WHEN 'DOWN' THEN p_down WHEN 'FLAT' THEN p_flat ELSE p_up END, 1e-9))), 6) AS log_loss FROM t GROUP BY year
"""


@query("flagship_forecast_scores", SQL)
def flagship(t: Tables) -> DataFrame:
    """Quarantine, weekly spine, bitemporal value at week end, weekly return, deadband class of the next one, purged folds by year, Laplace frequencies, scores."""
    good = quarantine(t.vintage, quarantine_reason())[0]
    pit = good.groupBy("series_id", "obs_date", "release_date").agg(F.max("value").alias("value")).withColumn("available_at", F.date_add("release_date", 1))
    spine = t.weekly.select("series_id", "week", F.date_add("week", 6).alias("day"))
    known = asof.pit_latest(spine, pit, ["series_id"], 60).where("known_value is not null").select("series_id", "week", F.col("known_value").alias("value"))
    # one pass over each series, whose weeks the calendar bounds, instead of joins of the same table with itself
    by_week = Window.partitionBy("series_id").orderBy("week")
    beside = lambda f, k: F.when(F.datediff(f("week").over(by_week), "week") == k, f("value").over(by_week))
    rows = known.withColumns({"before": beside(F.lag, -7), "next": beside(F.lead, 7)}).where("before is not null and next is not null")
    rows = rows.select("series_id", "week", F.year("week").alias("year"), classify(F.log(F.col("next") / F.col("value")), DEADBAND).alias("truth"))
    folds = rows.withColumn("fold", F.explode(F.array(*map(F.lit, YEARS))))
    train = folds.where((F.col("year") < F.col("fold")) & (F.date_add("week", 14) < F.make_date("fold", F.lit(1), F.lit(1))))
    from ..operators.forecast import frequency

    p = frequency(train, ["fold", "series_id"], "truth")
    test = folds.where("year = fold").join(p, ["fold", "series_id"])
    return r9(test.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg(scoring.brier_loss()).alias("brier"), F.avg(scoring.log_loss()).alias("log_loss")), 6)
