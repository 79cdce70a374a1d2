"""Fits per fold and calibration against numpy, and on folds with few rows, one class, nulls and ties."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.probability import CLASSES
from tidemark.operators import forecast as fc

PS = ("p_down", "p_flat", "p_up")
SCHEMA = "id int, a double, b double, truth string, y double"


def rows(n=300, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n) * 3
    z = np.stack([-a, np.zeros(n), a], 1) + rng.gumbel(size=(n, 3))
    return [(i, float(a[i]), float(b[i]), CLASSES[z[i].argmax()], float(2 * a[i] - b[i] + rng.normal() * 0.1)) for i in range(n)]


def softmax_fit(x, y, ridge, steps=4000):
    """Multinomial regression with a ridge on the weights but not on the intercepts, by plain gradient steps."""
    w, c, t = np.zeros((x.shape[1], 3)), np.zeros(3), np.eye(3)[y]
    for _ in range(steps):
        p = np.exp(x @ w + c)
        p /= p.sum(1, keepdims=True)
        w -= 0.5 * (x.T @ (p - t) / len(x) + ridge * w)
        c -= 0.5 * (p - t).mean(0)
    return w, c


def test_logistic_equals_a_plain_fit(spark):
    data = rows()
    train, test = spark.createDataFrame(data[:250], SCHEMA), spark.createDataFrame([*data[250:], (900, None, float("nan"), None, None)], SCHEMA)
    got = {r.id: [r[p] for p in PS] for r in fc.fit_logistic(train, test, ["a", "b"], "truth").collect()}
    assert len(got) == 51 and all(abs(sum(p) - 1) < 1e-9 for p in got.values())
    x = np.array([r[1:3] for r in data])
    mean, std = x[:250].mean(0), x[:250].std(0, ddof=1)
    w, c = softmax_fit((x[:250] - mean) / std, np.array([CLASSES.index(r[3]) for r in data[:250]]), 1 / 250)
    p = np.exp((x[250:] - mean) / std @ w + c)
    p /= p.sum(1, keepdims=True)
    assert np.abs(np.array([got[i] for i in range(250, 300)]) - p).max() < 0.01
    middle = np.exp((np.median(x[:250], axis=0) - mean) / std @ w + c)
    assert np.abs(np.array(got[900]) - middle / middle.sum()).max() < 0.01  # nulls and NaN take the medians of train


def test_ridge_equals_the_closed_form_and_residuals_make_classes(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumn("g", F.lit("g"))
    train, cal, test = df.where("id < 150"), df.where("id >= 150 and id < 250"), df.where("id >= 250")
    got = {r.id: r for r in fc.linear_distribution(train, cal, test.select("g", "id", "a", "b"), ["g"], ["a", "b"], "y", 0.5, alpha=1e-9).collect()}
    x = np.array([(1, *r[1:3]) for r in data])
    y = np.array([r[4] for r in data])
    w = np.linalg.lstsq(x[:150], y[:150], rcond=None)[0]
    residual = (y - x @ w)[150:250]
    for i in range(250, 300):
        m = x[i] @ w
        assert abs(got[i].predicted - m) < 1e-4 and got[i].n == 100
        assert abs(got[i].p_down - (m + residual < -0.5).mean()) < 0.021 and abs(got[i].p_up - (m + residual > 0.5).mean()) < 0.021
        assert abs(got[i].p_down + got[i].p_flat + got[i].p_up - 1) < 1e-9
    alone = fc.linear_distribution(train, cal.limit(0), test.select("g", "id", "a", "b"), ["g"], ["a", "b"], "y", 0.5)
    assert alone.count() == 50 and alone.where("p_up is not null or predicted is null").count() == 0


def test_boosted_learns_a_step_and_one_label_is_a_share(spark):
    df = spark.range(400).select(F.col("id").cast("int"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 >= 12).cast("int").alias("z"))
    (got,) = fc.fit_gbt(df, [df], ["a"], "z")
    assert got.count() == 400 and got.where("(p_one > 0.5) != (z = 1)").count() == 0
    one, two = fc.fit_gbt(df.where("z = 1"), [df, df.limit(0)], ["a"], "z")
    assert {r.p_one for r in one.collect()} == {160.5 / 161} and two.count() == 0


def isotonic(x, y):
    """Pool adjacent violators on distinct x."""
    blocks = [[np.mean(y[x == v]), np.sum(x == v), [v]] for v in np.unique(x)]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] > blocks[i + 1][0]:
            a, b = blocks[i], blocks.pop(i + 1)
            blocks[i] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
            i = max(i - 1, 0)
        else:
            i += 1
    return {v: m for m, _, vs in blocks for v in vs}


def test_calibration_of_classes(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([2, 2, 2], 200).round(2) + 1e-3
    p /= p.sum(1, keepdims=True)
    y = [CLASSES[rng.choice(3, p=q**2 / (q**2).sum())] for q in p]
    data = pd.DataFrame(p, columns=PS).assign(id=range(200), truth=y)
    df = spark.createDataFrame(data)
    for method in ("platt", "isotonic"):
        got = fc.calibrate_classes(df, df, PS, "truth", method)
        assert set(got.columns) == set(df.columns) and got.count() == 200
        q = got.orderBy("id").select(*PS).toPandas().to_numpy()
        assert np.abs(q.sum(1) - 1).max() < 1e-9 and q.min() >= 0
        own = np.eye(3)[[CLASSES.index(t) for t in y]]
        assert ((q - own) ** 2).sum(1).mean() < ((p - own) ** 2).sum(1).mean()
        assert fc.calibrate_classes(df.limit(0), df, PS, "truth", method).exceptAll(df).count() == 0
    up = fc.calibrate_binary(df.withColumn("u", (F.col("truth") == "UP").cast("int")), df, "p_up", "u", "isotonic").toPandas()
    want = isotonic(p[:, 2], np.array([t == "UP" for t in y], float))
    assert np.abs(up["calibrated"] - np.clip(up["p_up"].map(want), 1e-6, 1 - 1e-6)).max() < 1e-6
    flat = df.withColumn("u", F.lit(0))
    assert {r.calibrated for r in fc.calibrate_binary(flat, df, "p_up", "u").collect()} == {0.5 / 201}
    assert {r.calibrated for r in fc.calibrate_binary(flat.limit(0), df, "p_up", "u").collect()} == {0.5}


def test_folds_keep_all_their_test_rows(spark):
    data = [(i, y, "TRAIN" if y < f - 1 else "CAL" if y == f - 1 else "TEST" if y == f else None, f) for f in (3, 4) for i, y in enumerate([1, 1, 2, 2, 3, 3, 3, 4])]
    df = spark.createDataFrame(data, "id int, year int, role string, fold int")
    seen = []

    def fit(train, cal, test):
        seen.append((train.count(), cal.count(), test.count()))
        return test.select("fold", "id")

    got = fc.per_fold(df, fit)
    assert seen == [(2, 2, 3), (4, 3, 1)] and sorted(map(tuple, got.collect())) == [(3, 4), (3, 5), (3, 6), (4, 7)]
    assert fc.per_fold(df.limit(0), fit).count() == 0
