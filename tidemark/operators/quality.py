"""Quarantine, gates and cross-checks, with reason codes instead of dropped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def quarantine_reason(obs: str = "obs_date", release: str = "release_date", value: str = "value", series: str = "series_id", allow_negative: tuple[str, ...] = ()) -> Column:
    """Why a vintage row is not admitted, null if it is; series in allow_negative need only be finite."""
    x = F.col(value)
    exempt = F.col(series).isin(*allow_negative) if allow_negative else F.lit(False)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (~exempt & (x <= 0))
    return F.when(F.col(release) < F.col(obs), "RELEASE_PRECEDES_OBSERVATION").when(bad, "INVALID_PRICE")


def quarantine(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(admitted rows, other rows with `reason`)."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def parse_number(text: Column) -> Column:
    """Positive number, with thousands separators in the right places; else null."""
    ok = F.regexp_like(F.trim(text), F.lit(r"^([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?$"))
    n = F.when(ok, F.regexp_replace(F.trim(text), ",", "")).try_cast("double")
    return F.when(n > 0, n)


def valid_date(text: Column) -> Column:
    """Whether text is a YYYY-MM-DD day of the calendar."""
    ok = F.regexp_like(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    return F.coalesce(ok & F.when(ok, text).try_cast("date").isNotNull(), F.lit(False))


def project_strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with exactly these columns; unknown or missing ones are an error."""
    if extra := set(df.columns) ^ set(columns):
        raise ValueError(f"columns differ: {sorted(extra)}")
    return df.select(*columns)


def reasons(rules: dict[str, Column]) -> Column:
    """Sorted codes of the rules that a row breaks (their condition is true)."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in sorted(rules.items())]))


def record_gate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `codes`, the rules that each row breaks joined by commas, and `passed`."""
    return df.withColumn("codes", F.array_join(reasons(rules), ",")).withColumn("passed", F.col("codes") == "")


def completeness_gate(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or not expected, with which of both."""
    have = df.select(key).distinct()
    return expected.select(key).distinct().join(have, key, "left_anti").select(key, F.lit("MISSING").alias("issue")).union(have.join(expected.select(key).distinct(), key, "left_anti").select(key, F.lit("UNEXPECTED").alias("issue")))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check with the number of rows that break it, in one pass."""
    counts = df.agg(*[F.count_if(bad).alias(name) for name, bad in checks.items()])
    return counts.unpivot([], list(checks), "check", "violations")


def write_counted(df: DataFrame, path: str, checks: dict[str, Column]) -> DataFrame:
    """Write df and return a row per check with the number of rows that break it: the scan that writes counts, too."""
    seen = Observation()
    df.observe(seen, *[F.count_if(bad).alias(name) for name, bad in checks.items()]).write.parquet(path)
    return df.sparkSession.createDataFrame([(name, seen.get[name]) for name in checks], "check string, violations bigint")


def write_asserted(df: DataFrame, path: str, checks: dict[str, Column]) -> DataFrame:
    """Write df, read it back, and raise if any row breaks a check; a reader should then leave the path alone, as with any write that fails."""
    broken = [f"{r['check']}: {r.violations}" for r in write_counted(df, path, checks).where("violations > 0").collect()]
    if broken:
        raise ValueError(f"rows break {', '.join(broken)}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gate(checks: DataFrame) -> DataFrame:
    """PASS or FAIL over (check, passed), with the failed ones."""
    failed = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("check")))), ",")
    return checks.agg(F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("status"), failed.alias("failed"), F.count(F.lit(1)).alias("checks"))


def cross_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one read that the other lacks, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("FIRST")).union(b.exceptAll(a).withColumn("side", F.lit("SECOND")))


def revision_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Cells that were added, removed or changed by more than tolerance."""
    both = old.select(*keys, F.col(value).alias("old_value")).join(new.select(*keys, F.col(value).alias("new_value")), keys, "full")
    kind = F.when(F.col("old_value").isNull() & F.col("new_value").isNotNull(), "ADDED").when(F.col("new_value").isNull() & F.col("old_value").isNotNull(), "REMOVED").when(F.abs(F.col("new_value") - F.col("old_value")) > tolerance, "CHANGED")
    return both.withColumn("change", kind).where("change is not null")


def admission(stats: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """stats with the admission decision and the codes of the rules that fail."""
    return record_gate(stats, rules).withColumn("decision", F.when(F.col("passed"), "ADMITTED").otherwise("REJECTED")).drop("passed")


def mask_unavailable(df: DataFrame, cols: list[str], available: str, decision: str) -> DataFrame:
    """df with cols null where they were not yet available at the decision."""
    return df.withColumns({c: F.when(F.col(available) <= F.col(decision), F.col(c)) for c in cols})


#: Words that publishers use for a direction.
DIRECTIONS = {"up": "UP", "rise": "UP", "increase": "UP", "down": "DOWN", "fall": "DOWN", "decrease": "DOWN", "flat": "FLAT", "unchanged": "FLAT", "stable": "FLAT"}


def map_direction(text: Column, aliases: dict[str, str] = DIRECTIONS) -> Column:
    """Direction of a closed list of words, null for any other."""
    return F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[F.lower(F.trim(text))]
