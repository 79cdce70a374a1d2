"""Quantiles, lookups, dominance counts and greedy subsets against plain loops: ties, nulls, one row, one value, hot groups and long series."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks
from tidemark.operators.datasets import non_overlapping
from tidemark.operators.windows import expanding_percentile


def test_distribution_counts_smaller_rows(spark):
    rows = [("a", 3.0), ("a", 3.0), ("a", 1.0), ("a", None), (None, 2.0), (None, 5.0), ("c", None)]
    got = {(r.k, r.v): (r.n, r.before) for r in ranks.distribution(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {("a", 1.0): (1, 0), ("a", 3.0): (2, 1), (None, 2.0): (1, 0), (None, 5.0): (1, 1)}
    whole = ranks.distribution(spark.createDataFrame(rows, "k string, v double"), [], "v").collect()
    assert {(r.v, r.n, r.before) for r in whole} == {(1.0, 1, 0), (2.0, 1, 1), (3.0, 2, 2), (5.0, 1, 4)}


QS = [0.0, 0.05, 0.33, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("accuracy", [10_000, 20])  # with 20 the brackets are wide, or miss
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng = random.Random(3)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(20_000)], "ties": [float(rng.choice([1, 1, 1, 2])) for _ in range(3_000)], "one": [7.5], "two": [1.0, 2.0], None: [-0.0, 0.0, 3.0], "same": [4.0] * 500}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r[1:] for r in ranks.quantiles(df, ["k"], "v", QS).collect()}
    assert got.pop("none") == (None,) * len(QS)
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, QS), rtol=0, atol=1e-12), k


def test_lookups_count_as_sums_of_doubles_round(spark):
    rng = random.Random(5)
    residuals = [("g", rng.choice([-0.06, -0.05, 0.0, 0.05, 0.06, 0.1, 0.15, rng.gauss(0, 0.1)])) for _ in range(400)] + [("g", None), ("h", 0.3)]
    points = [("g", i, m) for i, m in enumerate([0.0, 0.01, -0.01, 0.1, -0.1, 1e9, -1e9, 1e-300, None] + [rng.gauss(0, 0.1) for _ in range(60)])] + [("x", 900, 0.0), ("h", 901, -0.35)]
    p = spark.createDataFrame(points, "k string, id int, m double")
    got = {r.id: (r.n, r.below, r.above) for r in ranks.counts_of_sums(p, spark.createDataFrame(residuals, "k string, r double"), ["k"], "m", "r", 0.05).collect()}
    own = {k: [r for g, r in residuals if g == k and r is not None] for k in "ghx"}
    for k, i, m in points:
        if m is not None and own[k]:
            assert got[i] == (len(own[k]), sum(m + r < -0.05 for r in own[k]), sum(m + r > 0.05 for r in own[k])), (i, m)
    assert got[8] == (400, None, None) and got[900] == (None, None, None)


def test_dominance_of_points():
    rng = np.random.default_rng(1)
    for n, most in ((0, 5), (1, 5), (60, 5), (300, 1000)):
        x, y, w = rng.integers(0, most, n), rng.integers(0, most, n), rng.integers(1, 4, n)
        assert ranks.dominated(x, y, w).tolist() == [int(w[(x < a) & (y < b)].sum()) for a, b in zip(x, y)]


@pytest.mark.parametrize("block", [None, 7])
@pytest.mark.parametrize("strict", [True, False])
def test_expanding_percentile_over_blocks(spark, block, strict):
    rng = random.Random(9)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    rows = [("long", day(i), rng.choice([1.0, 2.0, rng.gauss(0, 3)])) for i in range(150)] + [("long", day(40), rng.gauss(0, 3)) for _ in range(90)] + [("long", day(41), None), ("one", day(0), 1.0), (None, day(3), 2.0), (None, day(4), 2.0)]
    df = spark.createDataFrame(rows, "k string, at date, v double")
    want = []
    for k, at, v in rows:
        old = [o for j, d, o in rows if j == k and d < at and o is not None]
        share = None if not old else sum(v is not None and (o < v or not strict and o == v) for o in old) / len(old)
        want.append((str(k), str(at), str(v), len(old), share))
    got = [(str(r.k), str(r["at"]), str(r.v), r.earlier, r.percentile) for r in expanding_percentile(df, ["k"], "at", "v", strict, block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_non_overlapping_equals_the_fold(spark):
    rng = random.Random(2)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(n)
    rows = [(k, day(s), None if rng.random() < 0.05 else day(s + rng.randint(-2, 30))) for k in ("a", "b", None) for s in (rng.randint(0, 3000) for _ in range(700))] + [("one", day(5), day(9)), ("null", None, day(3))]
    got = sorted((str(r.k), r.s) for r in non_overlapping(spark.createDataFrame(rows, "k string, s date, e date"), ["k"], "s", "e").collect())
    want = []
    for k in {r[0] for r in rows}:
        last = None
        for s in sorted({r[1] for r in rows if r[0] == k and r[1]}):
            if last is None or s > last:
                want.append((str(k), s))
                last = min(max(s, r[2] or s) for r in rows if r[0] == k and r[1] == s)
    assert got == sorted(want)


def test_a_long_key(spark):
    """Many more rows than a block, all of one key: rows and rounds stay in proportion."""
    n = 60_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.expr("date_add(date '1900-01-01', cast(id as int))").alias("s"))
    got = non_overlapping(df.withColumn("e", F.date_add("s", 6)), ["k"], "s", "e")
    assert got.count() == (n + 6) // 7
    walk = df.withColumn("v", (F.hash("s") % 1000).cast("double"))
    rows = {r.s: r for r in expanding_percentile(walk, ["k"], "s", "v").where("s < '1900-01-20' or s > '2064-04-01'").collect()}
    plain = sorted((r.s, r.v) for r in walk.collect())
    for s, r in list(rows.items())[:60]:
        old = [v for d, v in plain if d < s]
        assert r.earlier == len(old) and (not old or abs(r.percentile - sum(v < r.v for v in old) / len(old)) < 1e-12)
