"""Bars, shares, quantiles, correlations and collapses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weekly_bars(df: DataFrame, keys: list[str], day: str, value: str, available: str | None = None, ends: str = "SUN", min_n: int = 1, drop_last: bool = False, null_short: bool = False) -> DataFrame:
    """Mean, count and latest availability by week.

    ends="SUN" names a week by its Monday, "FRI" by the Friday that it ends on.
    Weeks with fewer than min_n values are dropped, or with null_short kept
    without a mean; drop_last leaves out the last week of all.
    """
    if ends == "FRI":
        week = F.date_add(F.to_date(F.date_trunc("week", F.date_add(F.col(day), 2))), 4)
    else:
        week = F.to_date(F.date_trunc("week", F.col(day)))
    more = [F.max(available).alias("available_at")] if available else []
    bars = df.groupBy(*keys, week.alias("week")).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"), *more)
    if drop_last:
        last = df.agg(F.max(week).alias("last_week"))
        bars = bars.join(F.broadcast(last), F.col("week") < F.col("last_week")).drop("last_week")
    if null_short:
        return bars.withColumn("mean_value", F.when(F.col("n") >= min_n, F.col("mean_value")))
    return bars.where(F.col("n") >= min_n)


def class_shares(df: DataFrame, by: list[str], label: str, classes: tuple[str, ...] = ("DOWN", "FLAT", "UP")) -> DataFrame:
    """Rows, count and share of each class, least and greatest share."""
    n = F.count(F.lit(1))
    counts = df.groupBy(*by).agg(n.alias("n"), *[F.count_if(F.col(label) == c).alias(f"n_{c.lower()}") for c in classes])
    share = [F.col(f"n_{c.lower()}") / F.col("n") for c in classes]
    return counts.withColumns({"least_share": F.least(*share), "greatest_share": F.greatest(*share)})


def matched_median(panel: DataFrame, entity: str, week: str, value: str, min_n: int) -> DataFrame:
    """Median over entities of the log return from the week before; null if fewer than min_n match."""
    from .asof import calendar_lag

    moved = calendar_lag(panel, [entity], week, [value], 1).where(f"{value} > 0 and {value}_lag1 > 0")
    out = moved.groupBy(week).agg(F.median(F.log(F.col(value) / F.col(f"{value}_lag1"))).alias("median_return"), F.count(F.lit(1)).alias("matched"))
    return out.withColumn("median_return", F.when(F.col("matched") >= min_n, F.col("median_return")))


def pair_metrics(df: DataFrame, by: list[str], a: str, b: str, zero: float | None = 1e-12) -> DataFrame:
    """Correlation, rows, and agreement of signs; rows with a value within `zero` of 0 do not count for the signs (None: they do)."""
    x, y = F.col(a), F.col(b)
    counted = F.lit(True) if zero is None else (F.abs(x) > zero) & (F.abs(y) > zero)
    return df.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("correlation"), F.avg(F.when(counted, (F.sign(x) == F.sign(y)).cast("double"))).alias("sign_agreement"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of every pair of values, absent ones as 0, in one pass without a pivot job."""
    rows = F.explode(F.array(*map(F.lit, values))).alias(row)
    cells = df.where(F.col(row).isin(values)).groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    every = df.sparkSession.range(1).select(rows)
    return every.join(cells, row, "left").na.fill(0, values)


def block_sums(df: DataFrame, by: list[str], day: str, days: int, origin: str, sums: dict[str, Column]) -> DataFrame:
    """Sums by block of `days` days since origin."""
    block = F.floor(F.datediff(F.col(day), F.lit(origin).cast("date")) / days).cast("bigint")
    return df.groupBy(*by, block.alias("block")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def collapse_mirrors(df: DataFrame, keys: list[str], value: str, source: str) -> DataFrame:
    """One row per key: the value on which all sources agree, else CONFLICT and null, with the sorted sources."""
    one = F.count_distinct(value) == 1
    return df.groupBy(*keys).agg(F.when(one, F.min(value)).alias(value), F.when(one, "OK").otherwise("CONFLICT").alias("status"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"))


def latest(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Row of each key that is largest by order; combines before it shuffles."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def event_groups(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """All ids of each event, as rows, with one vote for each event: that of its least id. No event is gathered in one row."""
    first = df.groupBy(key).agg(F.min(id_col).alias("_first"))
    return df.select(key, id_col).join(first, key).select(key, id_col, (F.col(id_col) == F.col("_first")).cast("int").alias("vote"))


def representatives(df: DataFrame, by: list[str], id_col: str, structured: str, importance: str) -> DataFrame:
    """Id that stands for each group: structured first, then the most important, then the least id."""
    return df.groupBy(*by).agg(F.min_by(id_col, F.struct(~F.col(structured), -F.col(importance), F.col(id_col))).alias("representative"))
