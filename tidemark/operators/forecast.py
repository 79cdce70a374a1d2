"""Frequency baselines, empirical distributions, MLlib fits and calibrators, per fold."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probability import CLASSES
from ..session import cut


def frequency(train: DataFrame, by: list[str], label: str, prior: float = 1.0) -> DataFrame:
    """(n_c + prior) / (n + 3 prior) for each class: Laplace with 1, Jeffreys with 0.5."""
    n = train.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(label) == c).alias(f"_{i}") for i, c in enumerate(CLASSES)])
    return n.select(*by, *[((F.col(f"_{i}") + prior) / (F.col("_n") + 3 * prior)).alias(f"p_{c.lower()}") for i, c in enumerate(CLASSES)])


def conditional_frequency(train: DataFrame, by: list[str], condition: str, label: str, prior: float = 1.0) -> DataFrame:
    return frequency(train.where(F.col(condition).isNotNull()), [*by, condition], label, prior)


def soft_direction(label: Column, p: float) -> list[Column]:
    """Probability 1 - 2p on the given class and p on the others."""
    return [F.when(label == c, F.lit(1 - 2 * p)).otherwise(F.lit(p)) for c in CLASSES]


def blend_onehot(freq: list[Column], label: Column, weight: float | Column = 0.9) -> list[Column]:
    """weight on the class, the rest shared as the frequencies are."""
    return [(1 - weight) * f + weight * (label == c).cast("double") for f, c in zip(freq, CLASSES)]


def residual_cdf(points: DataFrame, residuals: DataFrame, by: list[str], mean: str, residual: str, t: float, prior: float = 0.0, how: str = "inner") -> DataFrame:
    """Class probabilities of mean + residual over the residuals of the same group.

    Below -t counts strictly, above t strictly; null residuals are left out. A
    point is looked up twice in the sorted distribution of its residuals. With
    how="left", points without residuals stay, with null probabilities.
    """
    from .ranks import counts_of_sums

    got = counts_of_sums(points, residuals, by, mean, residual, t)
    got = got if how == "left" else got.where("n > 0")
    n = F.col("n") + 3 * prior
    return got.select(*points.columns, "n", ((F.col("below") + prior) / n).alias("p_down"), ((F.col("n") - F.col("below") - F.col("above") + prior) / n).alias("p_flat"), ((F.col("above") + prior) / n).alias("p_up"))


def per_fold(folds: DataFrame, fit: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Union of fit(train, cal, test) over the folds of rows (fold, role, ...), roles as walk_forward gives them; purged rows are in none.

    Folds are a few test years. The rows are written once, as every fit reads them several times. A fold without TEST rows gives nothing.
    Folds may name the columns of their results in any order.
    """
    folds = cut(folds.where(F.col("role").isin("TRAIN", "CAL", "TEST")))
    years = [r["fold"] for r in folds.where("role = 'TEST'").select("fold").distinct().orderBy("fold").collect()]
    role = lambda y, r: folds.where((F.col("fold") == y) & (F.col("role") == r))
    parts = [fit(role(y, "TRAIN"), role(y, "CAL"), role(y, "TEST")) for y in years]
    return reduce(DataFrame.unionByName, parts) if parts else fit(folds, folds, folds.where(F.lit(False)))


def imputed(train: DataFrame, features: list[str], *others: DataFrame) -> list[DataFrame]:
    """train and others with `_raw`, the vector of features; a null or NaN takes the feature's median in train, or 0 if it has none there."""
    from pyspark.ml.feature import VectorAssembler

    medians = train.agg(*[F.median(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in features]).first().asDict()
    to_vector = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_raw")
    filled = {f"_f_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(medians[c] or 0.0))) for c in features}
    return [to_vector.transform(df.withColumns(filled)).drop(*filled) for df in (train, *others)]


def fit_logistic(train: DataFrame, test: DataFrame, features: list[str], label: str, c: float = 1.0) -> DataFrame:
    """test with p_down, p_flat, p_up of a multinomial logistic regression on scaled features; the ridge is 1 / (c n). All rows stay; without labelled rows the probabilities are null."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    index = F.create_map(*[x for i, k in enumerate(CLASSES) for x in (F.lit(k), F.lit(float(i)))])
    rows, asked = imputed(train.withColumn("_y", index[F.col(label)]).where("_y is not null"), features, test)
    n = rows.count()
    if not n:
        return test.select("*", *[F.lit(None).cast("double").alias(f"p_{k.lower()}") for k in CLASSES])
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(rows)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", family="multinomial", regParam=1 / (c * n), maxIter=50).fit(scaler.transform(rows))
    p, size = vector_to_array("_p"), model.numClasses
    scored = model.transform(scaler.transform(asked))
    return scored.select(*test.columns, *[(F.get(p, F.lit(i)) if i < size else F.lit(0.0)).alias(f"p_{k.lower()}") for i, k in enumerate(CLASSES)])


def fit_linear(train: DataFrame, test: DataFrame, features: list[str], label: str, alpha: float = 0.01, mixing: float = 0.0) -> DataFrame:
    """test with `predicted` of a ridge (mixing 0) or elastic-net regression; null without labelled rows."""
    from pyspark.ml.regression import LinearRegression

    rows, asked = imputed(train.where(F.col(label).isNotNull()), features, test)
    if rows.isEmpty():
        return test.withColumn("predicted", F.lit(None).cast("double"))
    model = LinearRegression(featuresCol="_raw", labelCol=label, predictionCol="predicted", regParam=alpha, elasticNetParam=mixing, maxIter=50).fit(rows)
    return model.transform(asked).select(*test.columns, "predicted")


def linear_distribution(train: DataFrame, cal: DataFrame, test: DataFrame, by: list[str], features: list[str], label: str, t: float, alpha: float = 0.01, mixing: float = 0.0) -> DataFrame:
    """test with `predicted` and class probabilities from the residuals of rows that the fit has not seen (cal), of the same `by`."""
    mean = fit_linear(train, test, features, label, alpha, mixing)
    seen = fit_linear(train, cal.where(F.col(label).isNotNull()), features, label, alpha, mixing)
    residuals = seen.select(*by, (F.col(label) - F.col("predicted")).alias("_residual"))
    return residual_cdf(mean, residuals, by, "predicted", "_residual", t, how="left")


def fit_gbt(train: DataFrame, tests: list[DataFrame], features: list[str], label: str, trees: int = 60) -> list[DataFrame]:
    """Each of tests with p_one of a shallow boosted classifier of a 0/1 label; with one label only, (k + 1/2) / (n + 1)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    rows, *asked = imputed(train.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), features, *tests)
    n, k = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0.0))).first()
    if k in (0, n):
        return [df.withColumn("p_one", F.lit((k + 0.5) / (n + 1))) for df in tests]
    model = GBTClassifier(featuresCol="_raw", labelCol=label, maxDepth=2, maxIter=trees, stepSize=0.1, minInstancesPerNode=25, seed=7).fit(rows)
    return [model.transform(a).select(*df.columns, vector_to_array("probability")[1].alias("p_one")) for a, df in zip(asked, tests)]


def fit_logistic_binary(train: DataFrame, tests: list[DataFrame], features: list[str], label: str, c: float = 1.0) -> list[DataFrame]:
    """Each of tests with p_one of a logistic regression of a 0/1 label on scaled features; with one label only, (k + 1/2) / (n + 1)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows, *asked = imputed(train.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), features, *tests)
    n, k = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0.0))).first()
    if k in (0, n):
        return [df.withColumn("p_one", F.lit((k + 0.5) / (n + 1))) for df in tests]
    model = LogisticRegression(featuresCol="_raw", labelCol=label, probabilityCol="_p", regParam=1 / (c * n), maxIter=50).fit(rows)
    return [model.transform(a).select(*df.columns, vector_to_array("_p")[1].alias("p_one")) for a, df in zip(asked, tests)]


def _inside(p: str, floor: float = 1e-6) -> Column:
    return F.least(F.greatest(F.col(p), F.lit(floor)), F.lit(1 - floor))


def calibrate_binary(cal: DataFrame, test: DataFrame, p: str, label: str, method: str = "platt") -> DataFrame:
    """test with `calibrated`, fitted on the probabilities p and 0/1 labels of cal: a logistic regression on the logit of p, or an isotonic one.

    With one label only, (k + 1/2) / (n + 1), which without any row is 1/2.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    known = cal.where(F.col(label).isNotNull() & F.col(p).isNotNull()).withColumn("_y", F.col(label).cast("double"))
    n, k = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0.0))).first()
    if k in (0, n):
        return test.withColumn("calibrated", F.lit((k + 0.5) / (n + 1)))
    x = F.log(_inside(p) / (1 - _inside(p))) if method == "platt" else _inside(p)
    rows, asked = imputed(known.withColumn("_l", x), ["_l"], test.withColumn("_l", x))
    if method == "platt":
        model = LogisticRegression(featuresCol="_raw", labelCol="_y", probabilityCol="_p", regParam=1 / n, standardization=False, maxIter=50).fit(rows)
        return model.transform(asked).select(*test.columns, vector_to_array("_p")[1].alias("calibrated"))
    model = IsotonicRegression(featuresCol="_raw", labelCol="_y", predictionCol="_c").fit(rows)
    return model.transform(asked).withColumn("calibrated", _inside("_c")).select(*test.columns, "calibrated")


def calibrate_classes(cal: DataFrame, test: DataFrame, ps: tuple[str, ...], truth: str, method: str = "platt") -> DataFrame:
    """test with calibrated class probabilities in place of ps, fitted on cal.

    platt: one multinomial regression on the log probabilities, which sums to one.
    isotonic: one fit per class, then divided by their sum; a sum of 0 gives a third each.
    Without rows to fit on, test stays as it is.
    """
    if cal.where(F.col(truth).isin(*CLASSES)).isEmpty():
        return test
    if method == "platt":
        logs = {f"_l{i}": F.log(F.greatest(F.col(p), F.lit(1e-9))) for i, p in enumerate(ps)}
        got = fit_logistic(cal.withColumns(logs), test.withColumns(logs).drop(*ps), list(logs), truth).drop(*logs)
        return got.select(*[c for c in test.columns if c not in ps], *[F.col(f"p_{k.lower()}").alias(p) for k, p in zip(CLASSES, ps)]).select(*test.columns)
    for i, (k, p) in enumerate(zip(CLASSES, ps)):
        own = cal.withColumn("_one", (F.col(truth) == k).cast("int"))
        test = calibrate_binary(own, test, p, "_one", "isotonic").withColumnRenamed("calibrated", f"_c{i}")
    total = sum((F.col(f"_c{i}") for i in range(1, len(ps))), F.col("_c0"))
    return test.withColumns({p: F.when(total > 0, F.col(f"_c{i}") / total).otherwise(1 / len(ps)) for i, p in enumerate(ps)}).drop(*[f"_c{i}" for i in range(len(ps))])
