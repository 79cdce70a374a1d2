"""Quantile boosting against a plain numpy version of it, by pinball loss on held-out rows."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import boosting

LEVELS = [0.05, 0.25, 0.5, 0.75, 0.95]


def pinball(y, p, level):
    d = y - p
    return np.maximum(level * d, (level - 1) * d).mean()


def plain(x, y, z, level, rounds=7, rate=0.3):
    """Depth-two trees on the gradient, splits at quantile edges, leaves at the quantile of what is lacking."""
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, 32) / 32)) for j in range(x.shape[1])]
    f, g_test = np.full(len(y), np.quantile(y, level)), np.full(len(z), np.quantile(y, level))

    def split(rows, g):
        best = (1e-12, None)
        for j, es in enumerate(edges):
            for e in es:
                left = rows & (x[:, j] <= e)
                right = rows & ~left
                if min(left.sum(), right.sum()) >= 20:
                    gain = g[left].sum() ** 2 / left.sum() + g[right].sum() ** 2 / right.sum() - g[rows].sum() ** 2 / rows.sum()
                    best = max(best, (gain, (j, e)), key=lambda b: b[0])
        return best[1]

    def sides(rows, test, s):
        return ((rows & (x[:, s[0]] <= s[1]), test & (z[:, s[0]] <= s[1])), (rows & (x[:, s[0]] > s[1]), test & (z[:, s[0]] > s[1]))) if s else ((rows, test),)

    for _ in range(rounds):
        g = level - (y < f)
        every = (np.ones(len(y), bool), np.ones(len(z), bool))
        for rows, test in sides(*every, split(every[0], g)):
            for leaf, asked in sides(rows, test, split(rows, g)):
                if leaf.any():
                    add = rate * np.quantile(y[leaf] - f[leaf], level)
                    g_test[asked] += add
                    f = np.where(leaf, f + add, f)
    return g_test


def test_pinball_loss_is_that_of_a_plain_version(spark):
    rng = np.random.default_rng(1)
    n = 1500
    x = rng.normal(size=(n, 3))
    y = 2 * (x[:, 0] > 0) + x[:, 1] + rng.normal(size=n) * np.where(x[:, 0] > 0, 1.5, 0.3)
    rows = [("a", i, *map(float, x[i]), float(y[i])) for i in range(n)] + [("b", n + i, float(i), 0.0, None, 7.0) for i in range(10)] + [("a", -1, None, float("nan"), 0.0, None)]
    df = spark.createDataFrame(rows, "g string, id int, u double, v double, w double, y double")
    train, test = df.where("id < 1000 or g = 'b'"), df.where("g = 'a' and id >= 1000").unionByName(spark.createDataFrame([("b", 9000, 3.0, 0.0, None, 0.0), ("none", 9001, 0.0, 0.0, 0.0, 0.0)], df.schema))
    got = {r.id: r.quantiles for r in boosting.fit_quantiles(train, test, ["g"], ["u", "v", "w"], "y", LEVELS, rounds=7).collect()}
    assert got.pop(9001) is None and got.pop(9000) == [7.0] * len(LEVELS)
    ours = np.array([got[i] for i in range(1000, n)])
    assert (np.diff(ours, axis=1) >= 0).all()
    for k, level in enumerate(LEVELS):
        a, b, c = (pinball(y[1000:], p, level) for p in (ours[:, k], plain(x[:1000], y[:1000], x[1000:], level), np.quantile(y[:1000], level)))
        assert a < 1.05 * b and a < 0.95 * c, (level, a, b, c)


def test_no_labelled_rows(spark):
    df = spark.createDataFrame([("a", 1.0, None)], "g string, u double, y double")
    assert boosting.fit_quantiles(df, df, ["g"], ["u"], "y", [0.5]).collect()[0].quantiles is None
    assert boosting.fit_quantiles(df, df.where(F.lit(False)), ["g"], ["u"], "y", [0.5]).count() == 0
