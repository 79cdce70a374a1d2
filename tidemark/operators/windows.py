"""Window features of regular series. Windows run over weekly bars, whose length the calendar bounds however many rows made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def returns(df: DataFrame, keys: list[str], order: str, value: str, ks: list[int], kind: str = "log", scale: float = 50.0) -> DataFrame:
    """k-step returns: log, simple, or differences of asinh(value / scale), which is defined through zero."""
    w, x = _w(keys, order), F.col(value)

    def one(k: int) -> Column:
        old = F.lag(x, k).over(w)
        if kind == "log":
            return F.when((x > 0) & (old > 0), F.log(x / old))
        return x / old - 1 if kind == "simple" else F.asinh(x / scale) - F.asinh(old / scale)

    return df.withColumns({f"r{k}": one(k) for k in ks})


def rolling(df: DataFrame, keys: list[str], order: str, value: str, ks: list[int], what: str) -> DataFrame:
    """std, mean distance (value / mean - 1), or z-score over the last k rows; null unless all k are there."""
    out = {}
    for k in ks:
        w = _w(keys, order).rowsBetween(-(k - 1), 0)
        x, full = F.col(value), F.count(value).over(w) == k
        got = {"std": F.stddev_samp(value).over(w), "ma_distance": x / F.avg(value).over(w) - 1, "mean": F.avg(value).over(w)}[what]
        out[f"{what}{k}"] = F.when(full, got)
    return df.withColumns(out)


def rolling_std_days(df: DataFrame, keys: list[str], day: str, value: str, days: int, min_n: int) -> DataFrame:
    """Sample deviation of the differences of value inside the last `days` days, at least min_n rows.

    The first row of a window has no difference inside it: its term is taken off
    the sums of the differences. Frames are bounded by days, and rows are dealt
    out by (keys, year) with a margin, so a long series is not one task.
    """
    number = F.unix_date(day)
    year = F.floor(number / 366)
    spread = df.withColumn("_part", F.explode(F.array(year, F.floor((number + 2 * days) / 366)))).distinct()
    order = Window.partitionBy(*keys, "_part").orderBy("_number")
    diff = spread.withColumn("_number", number).withColumn("_d", F.col(value) - F.lag(value).over(order))
    w = order.rangeBetween(-(days - 1), 0)
    n, s1, s2 = F.count("_d").over(w), F.sum("_d").over(w), F.sum(F.col("_d") * F.col("_d")).over(w)
    first = F.first("_d").over(w)
    has = first.isNotNull().cast("int")
    m, a, b = n - has, s1 - F.coalesce(first, F.lit(0.0)), s2 - F.coalesce(first * first, F.lit(0.0))
    rows = F.count(F.lit(1)).over(w)
    std = F.when((rows >= min_n) & (m >= 2), F.sqrt(F.greatest((b - a * a / m) / (m - 1), F.lit(0.0))))
    return diff.withColumn("std_days", std).where(F.col("_part") == F.floor(F.col("_number") / 366)).drop("_part", "_number", "_d")


def drawdown(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("drawdown", F.col(value) / F.max(value).over(w) - 1)


def momentum(df: DataFrame, r_short: str, k_short: int, r_long: str, k_long: int, r1: str) -> DataFrame:
    return df.withColumns({"momentum": F.col(r_short) / k_short - F.col(r_long) / k_long, "reversal": -F.col(r1)})


def rolling_corr(df: DataFrame, keys: list[str], order: str, a: str, b: str, k: int) -> DataFrame:
    w = _w(keys, order).rowsBetween(-(k - 1), 0)
    full = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).over(w) == k
    return df.withColumn("rolling_corr", F.when(full, F.corr(a, b).over(w)))


def expanding_percentile(df: DataFrame, keys: list[str], order: str, value: str, strict: bool = True, block: int | None = None) -> DataFrame:
    """Share of strictly earlier rows with a smaller (strict) or no larger value; null without earlier values.

    Rows without a value do not count as earlier ones, and none is smaller than a null. No pairs of rows and no lists are made: see `earlier_and_smaller`.
    """
    from .ranks import earlier_and_smaller

    # as many are no larger as are not larger, and larger ones are smaller with the sign turned
    asked = df.select(*keys, order, (F.col(value) if strict else -F.col(value)).alias(value))
    got = earlier_and_smaller(asked, keys, order, value, block)
    below = F.coalesce(F.col("smaller") if strict else F.col("earlier") - F.col("smaller"), F.lit(0))
    share = F.when(F.col("earlier") > 0, below / F.col("earlier"))
    return got.select(*keys, order, (F.col(value) if strict else -F.col(value)).alias(value), "earlier", share.alias("percentile"))


def trailing_state(df: DataFrame, keys: list[str], order: str, value: str, k: int = 20) -> DataFrame:
    """Share of the last k values (this one included) that are no larger, and strong above 2/3, weak below 1/3; null before k values."""
    w = _w(keys, order).rowsBetween(-(k - 1), 0)
    held = F.collect_list(value).over(w)
    share = F.when(F.size(held) == k, F.size(F.filter(held, lambda x: x <= F.col(value))) / k)
    return df.withColumn("trailing_percentile", share).withColumn("state", state_of(F.col("trailing_percentile")))


def state_of(p: Column) -> Column:
    return F.when(p.isNull(), None).when(p > 2 / 3, "STRONG").when(p < 1 / 3, "WEAK").otherwise("NEUTRAL")


def lag_features(df: DataFrame, keys: list[str], order: str, cols: list[str], available: str, k: int) -> DataFrame:
    """All features shifted by k grid rows, with the latest availability of any row up to that one."""
    w = _w(keys, order)
    upto = F.max(available).over(w.rowsBetween(Window.unboundedPreceding, -k))
    return df.withColumns({**{f"{c}_lag": F.lag(c, k).over(w) for c in cols}, f"{available}_lag": upto})


def lead_target(df: DataFrame, keys: list[str], week: str, value: str) -> DataFrame:
    """Next week's value; null unless the next row is exactly a week later."""
    w = _w(keys, week)
    return df.withColumn("target", F.when(F.datediff(F.lead(week).over(w), F.col(week)) == 7, F.lead(value).over(w)))


def segment_by_gap(df: DataFrame, keys: list[str], day: str, gap: int) -> DataFrame:
    """Numbered segments (from 0) that end where the next event is more than gap days away."""
    w = _w(keys, day)
    step = F.datediff(F.col(day), F.lag(day).over(w))
    return df.withColumn("gap_days", step).withColumn("segment", F.sum(F.coalesce((F.col("gap_days") > gap).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def season(df: DataFrame, week: str, period: float = 52.1775) -> DataFrame:
    angle = 2 * 3.141592653589793 * F.weekofyear(week) / period
    return df.withColumns({"season_sin": F.sin(angle), "season_cos": F.cos(angle)})


def chain_level(panel: DataFrame, entity: str, week: str, value: str, min_n: int, base: float = 100.0) -> DataFrame:
    """Level chained over weeks in which at least min_n entities have a value: the median over entities that have one in the valid week before, too.

    A valid week whose matches are fewer than min_n leaves the level as it was.
    """
    counts = panel.where(F.col(value) > 0).groupBy(week).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_n)
    order = Window.orderBy(week)  # one row per week of the calendar
    valid = counts.select(week, F.lag(week).over(order).alias("_before"))
    now = panel.where(F.col(value) > 0).join(valid, week)
    old = panel.where(F.col(value) > 0).select(entity, F.col(week).alias("_before"), F.col(value).alias("_old"))
    moved = now.join(old, [entity, "_before"]).groupBy(week).agg(F.median(F.log(F.col(value) / F.col("_old"))).alias("_r"), F.count(F.lit(1)).alias("matched"))
    step = F.when(F.col("matched") >= min_n, F.col("_r")).otherwise(0.0)
    joined = valid.join(moved, week, "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return joined.select(week, "matched", (base * F.exp(F.sum(F.coalesce(step, F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))).alias("level"))
