"""Time rules: weeks, local midnights, trading days, release schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", day))


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def available_at(day: Column, zone: str) -> Column:
    """UTC instant of the next local midnight in zone, from when a release that has only a date may be used."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def expected_trading_date(now_utc: Column, zone: str = "America/New_York", close_hour: int = 18) -> Column:
    """Last weekday whose local close has passed; weekends count for Friday. Holidays are taken out by `previous_open_day`."""
    local = F.from_utc_timestamp(now_utc, zone)
    day = F.when(F.hour(local) >= close_hour, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))
    back = F.when(F.dayofweek(day) == 7, 1).when(F.dayofweek(day) == 1, 2).otherwise(0)
    return F.date_sub(day, back)


def previous_open_day(df: DataFrame, day: str, holidays: DataFrame, holiday: str = "holiday", reach: int = 10) -> DataFrame:
    """df with `open_day`, the last weekday at or before day that is no holiday; a bounded explode and an anti join, no loop."""
    tries = df.select(day).distinct().withColumn("_try", F.explode(F.sequence(F.date_sub(F.col(day), reach), F.col(day)))).where(~F.dayofweek("_try").isin(1, 7))
    open_days = tries.join(F.broadcast(holidays.select(F.col(holiday).alias("_try"))), "_try", "left_anti").groupBy(day).agg(F.max("_try").alias("open_day"))
    return df.join(open_days, day, "left")


def release_at(df: DataFrame, period: str, exceptions: DataFrame, zone: str = "America/New_York", days: int = 5, time: str = "10:30:00") -> DataFrame:
    """df with `release_at`: period + days at a local time, unless `exceptions` (period, release_local) names another time."""
    regular = F.to_timestamp(F.concat_ws(" ", F.date_add(F.col(period), days).cast("string"), F.lit(time)))
    joined = df.join(F.broadcast(exceptions.select(F.col("period").alias(period), F.col("release_local"))), period, "left")
    return joined.withColumn("release_at", F.to_utc_timestamp(F.coalesce("release_local", regular), zone)).drop("release_local")


def report_available_at(df: DataFrame, report: str, exceptions: DataFrame, quarantines: DataFrame) -> DataFrame:
    """df with `available_on` (report + 11 days unless excepted) and whether the report lies in a quarantine interval (first_day, last_day)."""
    joined = df.join(F.broadcast(exceptions.select(F.col("report").alias(report), "available_on_exception")), report, "left")
    held = F.broadcast(quarantines.select("first_day", "last_day"))
    marked = joined.join(held, F.col(report).between(F.col("first_day"), F.col("last_day")), "left")
    out = marked.groupBy(*df.columns, "available_on_exception").agg(F.bool_or(F.col("first_day").isNotNull()).alias("quarantined"))
    return out.withColumn("available_on", F.when(~F.col("quarantined"), F.coalesce("available_on_exception", F.date_add(F.col(report), 11)))).drop("available_on_exception")


def date_phrase(day: Column, now: Column) -> Column:
    """today, yesterday, or the number of days ago."""
    d = F.datediff(now, day)
    return F.when(d == 0, "today").when(d == 1, "yesterday").when(d > 1, F.concat(d.cast("string"), F.lit(" days ago"))).otherwise("upcoming")
