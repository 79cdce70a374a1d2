"""As-of and bitemporal joins, bounded range joins and lag joins.

Every time join is bounded by a tolerance, so both sides are dealt out by (keys,
time bucket) and no task gets a whole series: a right row is sent to the bucket
it lies in and to the neighbour that it can still reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(day: Column, width: int) -> Column:
    return F.floor(F.unix_date(day) / F.lit(width)).cast("bigint")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, cols: list[str], tolerance: int, forward: bool = False, order: Column | None = None) -> DataFrame:
    """left with `cols` of the nearest right row at or before left_day (forward: at or after), at most tolerance days away.

    Of several right rows of a day the one largest by `order` (all cols if None)
    counts. Left rows without a match keep nulls; null days match nothing.
    """
    width = tolerance + 1
    rank = order if order is not None else F.struct(*cols)
    days = right.where(F.col(right_day).isNotNull()).groupBy(*keys, F.col(right_day).alias("_day")).agg(F.max_by(F.struct(*cols), rank).alias("_row"))
    step = -1 if forward else 1
    days = days.withColumn("_bucket", F.explode(F.array(_bucket(F.col("_day"), width), _bucket(F.col("_day"), width) + step)))
    side = left.withColumn("_day", F.col(left_day)).withColumn("_bucket", _bucket(F.col(left_day), width))
    own = F.struct(*[F.col(c) for c in left.columns])
    both = side.select(*keys, "_bucket", "_day", own.alias("_left"), F.lit(None).cast(days.schema["_row"].dataType).alias("_row")).unionByName(
        days.select(*keys, "_bucket", "_day", F.lit(None).cast(side.select(own.alias("x")).schema["x"].dataType).alias("_left"), "_row")
    )
    is_left = F.col("_left").isNotNull().cast("int")
    w = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_day") if forward else F.asc("_day"), is_left).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("_row").isNotNull(), F.struct("_day", "_row")), ignorenulls=True).over(w)
    found = both.withColumn("_hit", hit).where("_left is not null")
    near = F.abs(F.datediff(F.col("_hit._day"), F.col("_day"))) <= tolerance
    names = {c for c in left.columns}
    return found.select(*[F.col(f"_left.{c}").alias(c) for c in left.columns], *[F.when(near, F.col(f"_hit._row.{c}")).alias(c if c not in names else f"right_{c}") for c in cols])


def pit_latest(spine: DataFrame, vintages: DataFrame, keys: list[str], max_age: int, at: str = "day", obs: str = "obs_date", available: str = "available_at", value: str = "value") -> DataFrame:
    """For each spine row, the latest observation whose value was available at that day, in its latest known revision.

    Observations older than max_age days count as unknown. One running maximum of
    (observation, availability, value) in order of availability, within (keys, bucket).
    """
    width = max_age + 1
    known = vintages.where(F.col(obs).isNotNull() & F.col(available).isNotNull()).groupBy(*keys, obs, available).agg(F.max(value).alias(value))
    known = known.withColumn("_bucket", F.explode(F.array(_bucket(F.col(obs), width), _bucket(F.col(obs), width) + 1)))
    fact = F.struct(F.col(obs).alias("obs"), F.col(available).alias("known"), F.col(value).alias("value"))
    own = F.struct(*[F.col(c) for c in spine.columns])
    kinds = spine.select(own.alias("x")).schema["x"].dataType, known.select(fact.alias("x")).schema["x"].dataType
    rows = spine.select(*keys, _bucket(F.col(at), width).alias("_bucket"), F.col(at).alias("_t"), F.lit(1).alias("_side"), own.alias("_own"), F.lit(None).cast(kinds[1]).alias("_fact")).unionByName(
        known.select(*keys, "_bucket", F.col(available).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(kinds[0]).alias("_own"), fact.alias("_fact"))
    )
    w = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_hit", F.max("_fact").over(w)).where("_side = 1")
    fresh = F.datediff(F.col("_t"), F.col("_hit.obs")) <= max_age
    return found.select(*[F.col(f"_own.{c}").alias(c) for c in spine.columns], F.when(fresh, F.col("_hit.obs")).alias("known_obs"), F.when(fresh, F.col("_hit.known")).alias("known_at"), F.when(fresh, F.col("_hit.value")).alias("known_value"))


def pit_candidates(spine: DataFrame, vintages: DataFrame, keys: list[str], days: tuple[int, int], at: str = "day", anchor: str | None = None) -> DataFrame:
    """Spine rows with every observation from days[0] to days[1] days before `anchor` (default: the day itself) that was available at that day, in its latest known revision.

    The spine explodes to the bounded range of observation days and joins on equal keys.
    """
    base = F.col(anchor or at)
    wide = spine.where(base.isNotNull()).withColumn("obs_date", F.explode(F.sequence(F.date_sub(base, days[0]), F.date_sub(base, days[1]))))
    known = wide.join(vintages.select(*keys, "obs_date", "available_at", "value"), [*keys, "obs_date"]).where(F.col("available_at") <= F.col(at))
    return known.groupBy(*spine.columns, "obs_date").agg(F.max_by(F.struct("available_at", "value"), F.struct("available_at", "value")).alias("_r")).select(*spine.columns, "obs_date", F.col("_r.available_at").alias("available_at"), F.col("_r.value").alias("value"))


def pit_anchor(spine: DataFrame, vintages: DataFrame, keys: list[str], back: int, slack: int, max_age: int) -> DataFrame:
    """pit_latest with the value `back` days before its observation (at most slack days earlier still), as known at the same day."""
    now = pit_latest(spine, vintages, keys, max_age)
    found = pit_candidates(now, vintages, keys, (back + slack, back), anchor="known_obs")
    old = found.groupBy(*spine.columns).agg(F.max_by(F.struct("obs_date", "value"), "obs_date").alias("_a"))
    return now.join(old, spine.columns, "left").select(*now.columns, F.col("_a.obs_date").alias("anchor_obs"), F.col("_a.value").alias("anchor_value"))


def pit_tail(spine: DataFrame, vintages: DataFrame, keys: list[str], k: int, gap: int) -> DataFrame:
    """Count, first and last day and mean of the last k observations known at each spine day, over the bounded range k * gap."""
    found = pit_candidates(spine, vintages, keys, (k * gap, 1))
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy(*spine.columns).orderBy(F.desc("obs_date")))).where(F.col("_n") <= k)
    step = F.datediff(F.col("obs_date"), F.lag("obs_date").over(Window.partitionBy(*spine.columns).orderBy("obs_date")))
    stepped = ranked.withColumn("_step", step)
    return stepped.groupBy(*spine.columns).agg(F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("first_obs"), F.max("obs_date").alias("last_obs"), F.avg("value").alias("mean_value"), F.coalesce(F.max("_step"), F.lit(0)).alias("widest_gap"))


def seasonal_peers(df: DataFrame, keys: list[str], year: str, week: str, value: str, years: int = 5, reach: int = 3, weeks: int = 53) -> DataFrame:
    """Each row with its peers: the prior `years` years, within `reach` ISO weeks on a circle of `weeks`. The years explode to an equal key."""
    me = df.select(*keys, F.col(year).alias("y"), F.col(week).alias("w")).withColumn("peer_year", F.explode(F.sequence(F.col("y") - years, F.col("y") - 1)))
    peer = df.select(*keys, F.col(year).alias("peer_year"), F.col(week).alias("peer_week"), F.col(value).alias("peer_value"))
    apart = F.abs(F.col("w") - F.col("peer_week"))
    return me.join(peer, [*keys, "peer_year"]).where(F.least(apart, weeks - apart) <= reach)


def lag_join(a: DataFrame, b: DataFrame, week: str, lags: list[int]) -> DataFrame:
    """a joined with b shifted by each lag of weeks, on equal weeks only."""
    shifted = a.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("_w", F.date_add(F.col(week), F.col("lag") * 7))
    return shifted.join(b.withColumnRenamed(week, "_w"), "_w").drop("_w")


def calendar_lag(df: DataFrame, keys: list[str], week: str, cols: list[str], k: int) -> DataFrame:
    """df with each of cols as it was exactly k weeks before (null if that week is missing)."""
    old = df.select(*keys, F.date_add(F.col(week), 7 * k).alias(week), *[F.col(c).alias(f"{c}_lag{k}") for c in cols])
    return df.join(old, [*keys, week], "left")


def grid(**axes: DataFrame) -> DataFrame:
    """All combinations of small tables of settings, one value column each."""
    out = None
    for frame in axes.values():
        out = frame if out is None else out.crossJoin(F.broadcast(frame))
    return out


def resolve_outcomes(forecasts: DataFrame, prices: DataFrame, keys: list[str], made: str, day: str, value: str, horizon: int, tolerance: int) -> DataFrame:
    """Forecasts with the first price at or after made + horizon days, at most tolerance days later."""
    due = forecasts.withColumn("due_date", F.date_add(F.col(made), horizon))
    return asof_join(due, prices.select(*keys, day, F.col(day).alias("outcome_date"), F.col(value).alias("outcome_value")), keys, "due_date", day, ["outcome_date", "outcome_value"], tolerance, forward=True)
