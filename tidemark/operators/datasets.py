"""Labels, snapshots, purged splits, audits of leakage, trend rules and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .asof import asof_join
from .ranks import distribution, same


def build_labels(spine: DataFrame, series: DataFrame, keys: list[str], horizon: int, slack_back: int, slack_on: int) -> DataFrame:
    """Return from the last observation at or before each day to the first at or after day + horizon, known when both are; unfinished horizons are dropped."""
    start = series.select(*keys, "obs_date", F.col("obs_date").alias("start_date"), F.col("value").alias("start_value"), F.col("available_at").alias("start_known"))
    end = series.select(*keys, "obs_date", F.col("obs_date").alias("end_date"), F.col("value").alias("end_value"), F.col("available_at").alias("end_known"))
    left = asof_join(spine, start, keys, "day", "obs_date", ["start_date", "start_value", "start_known"], slack_back)
    both = asof_join(left.withColumn("_due", F.date_add("day", horizon)), end, keys, "_due", "obs_date", ["end_date", "end_value", "end_known"], slack_on, forward=True).drop("_due")
    done = both.where("start_date is not null and end_date is not null")
    return done.select(*spine.columns, "start_date", "end_date", F.log(F.col("end_value") / F.col("start_value")).alias("label_return"), F.greatest("start_known", "end_known").alias("label_known_at"))


def exclusion(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason that holds; null rows are kept."""
    out = F.lit(None).cast("string")
    for code, bad in reversed(reasons):
        out = F.when(bad, code).otherwise(out)
    return out


def choose_threshold(labels: DataFrame, value: str, candidates: list[float], least: float, most: float) -> DataFrame:
    """Class shares at each candidate and which is chosen: the smallest with all shares in [least, most], else the one closest to thirds."""
    counts = labels.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"_{i}_{k}") for i, t in enumerate(candidates) for k, c in (("d", F.col(value) < -t), ("u", F.col(value) > t))])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(f"_{i}_d") / F.col("n")).alias("down"), (F.col(f"_{i}_u") / F.col("n")).alias("up")) for i, t in enumerate(candidates)]))
    table = counts.select(rows.alias("_r")).select("_r.*").withColumn("flat", 1 - F.col("down") - F.col("up"))
    table = table.withColumn("balanced", (F.least("down", "flat", "up") >= least) & (F.greatest("down", "flat", "up") <= most)).withColumn("distance", F.round(F.abs(F.col("flat") - 1 / 3), 9))
    best = table.agg(F.coalesce(F.min(F.when(F.col("balanced"), F.col("threshold"))), F.min_by("threshold", F.struct("distance", "threshold"))).alias("_best"))
    return table.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("threshold") == F.col("_best")).drop("_best")


def walk_forward(df: DataFrame, years: list[int], decision: str, known: str, group: str | None = None) -> DataFrame:
    """Rows with fold and role for each test year: TRAIN before the year before, CAL in it, TEST in it, PURGED if the label was known only after the next block began.

    The fold table is small and explodes; the start of each block is one aggregate per fold.
    With group, the year of a group's first decision counts for all its rows.
    """
    year = F.year(decision)
    if group:
        first = df.groupBy(group).agg(F.min(decision).alias("_first"))
        df, year = df.join(first, group), F.year("_first")
    folds = df.withColumn("fold", F.explode(F.array(*map(F.lit, years)))).withColumn("_y", year)
    role = F.when(F.col("_y") < F.col("fold") - 1, "TRAIN").when(F.col("_y") == F.col("fold") - 1, "CAL").when(F.col("_y") == F.col("fold"), "TEST")
    roled = folds.withColumn("role", role).where("role is not null")
    starts = roled.groupBy("fold").agg(F.min(F.when(F.col("role") == "CAL", F.col(decision))).alias("_cal"), F.min(F.when(F.col("role") == "TEST", F.col(decision))).alias("_test"))
    late = F.when(F.col("role") == "TRAIN", F.col(known) >= F.coalesce("_cal", "_test")).when(F.col("role") == "CAL", F.col(known) >= F.col("_test"))
    return roled.join(F.broadcast(starts), "fold").withColumn("role", F.when(F.coalesce(late, F.lit(False)), "PURGED").otherwise(F.col("role"))).drop("_y", "_cal", "_test", "_first")


def final_split(df: DataFrame, day: str, develop_until: str, final_from: str) -> DataFrame:
    """DEVELOPMENT before one bound, FINAL from the other on, GAP between."""
    d = F.col(day)
    return df.withColumn("split", F.when(d < F.lit(develop_until).cast("date"), "DEVELOPMENT").when(d >= F.lit(final_from).cast("date"), "FINAL").otherwise("GAP"))


def fold_audit(folds: DataFrame, decision: str) -> DataFrame:
    return folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min(decision).alias("first_decision"), F.max(decision).alias("last_decision"))


def audit_leakage(snapshots: DataFrame, provenance: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs of features that were not available at the decision, lie after the target's start, or differ from the stored value; none is right."""
    joined = snapshots.join(provenance, keys)
    code = exclusion([("NOT_AVAILABLE", F.col("available_at") > F.col("decision")), ("AFTER_TARGET_START", F.col("obs_date") >= F.col("target_start")), ("VALUE_DIFFERS", F.col("feature_value") != F.col("source_value"))])
    return joined.withColumn("code", code).where("code is not null")


def non_overlapping(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Starts of the rows taken greedily in order of start: a row is taken if it starts after the end of the last one taken.

    Of rows with one start the one that ends first counts; a null end, or one
    before the start, is the start. A start points to the first one after its
    end, by its number among the starts. A round follows the pointers of all
    that are taken and then doubles every pointer, so that rounds are the
    logarithm of the rows taken, and a long key is joins like any other.
    """
    rows = df.where(F.col(start).isNotNull()).select(*keys, F.col(start).alias("_s"), F.greatest(F.col(start), F.col(end)).alias("_e"))
    rows = cut(rows.groupBy(*keys, "_s").agg(F.min("_e").alias("_e")))
    probes = rows.select(*keys, F.col("_s").alias("_x"), F.lit(1).alias("_w")).unionByName(rows.select(*keys, F.col("_e").alias("_x"), F.lit(0).alias("_w")))
    table = cut(distribution(probes, keys, "_x", F.col("_w")))
    number = table.where("n > 0").select(*keys, F.col("_x").alias("_s"), F.col("before").alias("_i"))
    after = table.select(*keys, F.col("_x").alias("_e"), (F.col("before") + F.col("n")).alias("_to"))
    placed = rows.alias("r").join(number.alias("n"), same("r", "n", [*keys, "_s"])).select(*[F.col(f"r.{c}").alias(c) for c in [*keys, "_s", "_e"]], "_i")
    placed = cut(placed.alias("r").join(after.alias("n"), same("r", "n", [*keys, "_e"])).select(*[F.col(f"r.{c}").alias(c) for c in [*keys, "_s", "_i"]], "_to"))

    def follow(a: DataFrame, at: str, jumps: DataFrame) -> DataFrame:
        """Rows of a with the place that they reach from `at` in its stead; those that run out of places are gone."""
        to = jumps.select(*keys, F.col("_i").alias(at), F.col("_to").alias("_next"))
        return a.alias("a").join(to.alias("j"), same("a", "j", [*keys, at])).select(*[F.col("_next").alias(c) if c == at else F.col(f"a.{c}").alias(c) for c in a.columns])

    there = placed.select(*keys, F.col("_i").alias("_to"))  # a pointer past the last start leads nowhere
    jumps = placed.select(*keys, "_i", "_to").alias("j").join(there.alias("p"), same("j", "p", [*keys, "_to"]), "left_semi")
    taken = placed.where("_i = 0").select(*keys, "_i")
    while True:
        more = cut(follow(taken, "_i", jumps))
        if more.isEmpty():
            break
        taken, jumps = taken.unionByName(more), cut(follow(jumps, "_to", jumps))
    return placed.alias("p").join(taken.alias("t"), same("p", "t", [*keys, "_i"]), "left_semi").select(*keys, F.col("_s").alias(start))


def strata(df: DataFrame, day: str, target: str, distances: list[int]) -> DataFrame:
    """Rows on Mondays, and their distance in days to target if it is one of distances."""
    d = F.datediff(F.col(target), F.col(day))
    return df.withColumn("is_monday", F.dayofweek(day) == 2).withColumn("distance", F.when(d.isin(*distances), d))


def trend_rule(df: DataFrame, day: str, a: str, b: str) -> DataFrame:
    """Direction of the mean of two series over 1, 3 and 7 days on days that both have.

    UP or DOWN if the 7-day change exceeds 2 % and the 1-day change does not turn by more than 1 %, else SIDEWAYS; null anchors give no trend.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.lit(0).alias("_one"), day, ((F.col(a) + F.col(b)) / 2).alias("level"))
    out = both
    for k in (1, 3, 7):
        anchors = both.select("_one", F.col(day).alias("_d"), F.col("level").alias(f"level_{k}"))
        out = asof_join(out.withColumn(f"_t{k}", F.date_sub(F.col(day), k)), anchors, ["_one"], f"_t{k}", "_d", [f"level_{k}"], 3).drop(f"_t{k}")
    change = {k: F.col("level") / F.col(f"level_{k}") - 1 for k in (1, 3, 7)}
    trend = F.when(change[1].isNull() | change[7].isNull(), None).when((change[7] > 0.02) & (change[1] > -0.01), "UP").when((change[7] < -0.02) & (change[1] < 0.01), "DOWN").otherwise("SIDEWAYS")
    return out.select(day, change[1].alias("change1"), change[3].alias("change3"), change[7].alias("change7"), trend.alias("trend"))


def freshness(df: DataFrame, checked: Column, expires: Column, now: Column) -> DataFrame:
    """UNAVAILABLE without a check, STALE after expiry, else LIVE, with the reason."""
    status = F.when(checked.isNull(), "UNAVAILABLE").when(expires < now, "STALE").otherwise("LIVE")
    reason = F.when(checked.isNull(), "NEVER_CHECKED").when(checked > now, "CHECKED_IN_FUTURE").when(expires < now, "EXPIRED")
    return df.withColumn("freshness", status).withColumn("freshness_reason", reason)
