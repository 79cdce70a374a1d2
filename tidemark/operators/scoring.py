"""Scores, reliability, calibration errors and comparisons of class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import CLASSES, argmax_class

PS = ("p_down", "p_flat", "p_up")


def brier_loss(truth: str = "truth", ps: tuple[str, ...] = PS) -> Column:
    """Sum over classes of squared errors."""
    out = F.lit(0.0)
    for c, p in zip(CLASSES, ps):
        e = F.col(p) - (F.col(truth) == c).cast("int")
        out = out + e * e
    return out


def log_loss(truth: str = "truth", ps: tuple[str, ...] = PS, floor: float = 1e-9) -> Column:
    p = F.when(F.col(truth) == CLASSES[0], F.col(ps[0])).when(F.col(truth) == CLASSES[1], F.col(ps[1])).otherwise(F.col(ps[2]))
    return -F.log(F.greatest(p, F.lit(floor)))


def score(df: DataFrame, by: list[str], truth: str = "truth") -> DataFrame:
    """Rows, Brier, log loss, accuracy, macro F1 and predicted counts, in one aggregation."""
    rows = df.withColumn("_hat", argmax_class(*PS))
    hit = F.col("_hat") == F.col(truth)
    sums = [F.count_if(hit & (F.col(truth) == c)).alias(f"_tp{i}") for i, c in enumerate(CLASSES)] + [F.count_if(F.col(truth) == c).alias(f"_n{i}") for i, c in enumerate(CLASSES)]
    got = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(brier_loss(truth)).alias("brier"), F.avg(log_loss(truth)).alias("log_loss"), F.avg(hit.cast("double")).alias("accuracy"), *[F.count_if(F.col("_hat") == c).alias(f"predicted_{c.lower()}") for c in CLASSES], *sums)
    f1 = F.lit(0.0)
    for i, c in enumerate(CLASSES):
        d = F.col(f"predicted_{c.lower()}") + F.col(f"_n{i}")
        f1 = f1 + F.when(d > 0, 2 * F.col(f"_tp{i}") / d).otherwise(0.0)
    return got.withColumn("macro_f1", f1 / 3).drop(*[f"_{k}{i}" for k in ("tp", "n") for i in range(3)])


#: Ranges that values are cut into for ranks.
RANK_RANGES = 64


def binary_score(df: DataFrame, p: str, y: str) -> DataFrame:
    """Rows, Brier, log loss, accuracy and AUC.

    Ranks come from counts per distinct p; those are ranked within ranges of p, cut
    by quantiles, whose totals are added up, so that no task ranks all of them.
    """
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    base = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"),
        F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"), F.sum(F.col(y).cast("bigint")).alias("_pos"),
    )
    ties = df.groupBy(p).agg(F.count(F.lit(1)).alias("_c"), F.sum(F.col(y).cast("bigint")).alias("_y"))
    edges = sorted(set(df.agg(F.percentile_approx(p, [i / RANK_RANGES for i in range(1, RANK_RANGES)], 10_000)).first()[0] or []))
    ties = ties.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(p))) if edges else F.lit(0))
    totals = ties.groupBy("_b").agg(F.sum("_c").alias("_n"))  # RANK_RANGES rows at most
    totals = totals.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lower"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_b").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_lower")
    ranked = ties.join(F.broadcast(totals), "_b").withColumn("_rank", before + (F.col("_c") + 1) / 2).agg(F.sum(F.col("_rank") * F.col("_y")).alias("_ranks"))
    pos, neg = F.col("_pos"), F.col("n") - F.col("_pos")
    return base.crossJoin(F.broadcast(ranked)).withColumn("auc", F.when((pos > 0) & (neg > 0), (F.col("_ranks") - pos * (pos + 1) / 2) / (pos * neg))).drop("_pos", "_ranks")


def long_classes(df: DataFrame, by: list[str], truth: str = "truth") -> DataFrame:
    """One row per row and class: by, class, p, hit."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(p).alias("p"), (F.col(truth) == c).cast("int").alias("hit")) for c, p in zip(CLASSES, PS)]))
    return df.select(*by, cells.alias("_c")).select(*by, "_c.*")


def reliability(df: DataFrame, by: list[str], bins: int = 10, offset: bool = False) -> DataFrame:
    """Count, mean probability and share of hits per class and bin, absent bins as 0.

    Bin floor(p * bins), the last one closed. With offset, edges lie half a bin
    lower: 0, 0.05, 0.15, ... 1.
    """
    long = long_classes(df, by)
    bin_of = F.least(F.floor(F.col("p") * bins + (0.5 if offset else 0.0)), F.lit(bins - (0 if offset else 1))).cast("int")
    got = long.groupBy(*by, "class", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("hit").cast("double")).alias("share"))
    every = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    full = every.withColumn("class", F.explode(F.array(*map(F.lit, CLASSES)))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - (0 if offset else 1)))))
    return full.join(got, [*by, "class", "bin"], "left").na.fill(0, ["n"])


def calibration_error(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error of each class, their mean, and that of the top label."""
    table = reliability(df, by, bins).where("n > 0")
    per_class = table.groupBy(*by, "class").agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("e"))
    classes = per_class.groupBy(*by).agg(*[F.max(F.when(F.col("class") == c, F.col("e"))).alias(f"ece_{c.lower()}") for c in CLASSES], F.avg("e").alias("ece_mean"))
    top, hit = F.greatest(*map(F.col, PS)), (argmax_class(*PS) == F.col("truth")).cast("double")
    bin_of = F.least(F.floor(top * bins), F.lit(bins - 1))
    tops = df.groupBy(*by, bin_of.alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(top).alias("m"), F.avg(hit).alias("s"))
    top_error = tops.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("m") - F.col("s"))) / F.sum("n")).alias("ece_top"))
    return classes.join(top_error, by) if by else classes.crossJoin(top_error)


def band_check(df: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Rows, mean and share of hits of all class probabilities in [low, high]."""
    return long_classes(df, by).where(F.col("p").between(low, high)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("hit").cast("double")).alias("share"))


def paired_losses(df: DataFrame, a: str, b: str, extra: list[str]) -> DataFrame:
    """Loss of models a and b on the same rows, and a's less b's; one aggregation, no join."""
    loss = brier_loss()
    got = df.where(F.col("model").isin(a, b)).groupBy("row_id", *extra).agg(F.max(F.when(F.col("model") == a, loss)).alias("loss_a"), F.max(F.when(F.col("model") == b, loss)).alias("loss_b"))
    return got.where("loss_a is not null and loss_b is not null").withColumn("difference", F.col("loss_a") - F.col("loss_b"))


def select_candidate(scores: DataFrame, candidate: str, year: str, baseline: str) -> DataFrame:
    """Candidates by the mean over years of (Brier + log loss relative to the baseline's) / 2, and which is chosen; ties by name."""
    base = scores.where(F.col(candidate) == baseline).select(year, F.col("brier").alias("_b"), F.col("log_loss").alias("_l"))
    ratio = (F.col("brier") / F.col("_b") + F.col("log_loss") / F.col("_l")) / 2
    means = scores.join(base, year).groupBy(candidate).agg(F.round(F.avg(ratio), 6).alias("ratio"), F.count(F.lit(1)).alias("years"))
    best = means.agg(F.min_by(candidate, F.struct("ratio", candidate)).alias("_best"))
    return means.crossJoin(F.broadcast(best)).withColumn("chosen", F.col(candidate) == F.col("_best")).drop("_best")


def year_stability(scores: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """Years in which each candidate beats the baseline on both scores, and whether it is never worse on both."""
    base = scores.where(F.col("model") == baseline).select("year", F.col("brier").alias("_b"), F.col("log_loss").alias("_l"))
    both = scores.where(F.col("model") != baseline).join(base, "year")
    better, worse = (F.col("brier") < F.col("_b")) & (F.col("log_loss") < F.col("_l")), (F.col("brier") > F.col("_b")) & (F.col("log_loss") > F.col("_l"))
    return both.groupBy(candidate).agg(F.count(F.lit(1)).alias("years"), F.count_if(better).alias("better_years"), (F.count_if(worse) == 0).alias("never_worse"))
