"""Nearest neighbours on a scalar against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.nearest import nearest_k


def brute(q, r, k):
    far = lambda x, y: (1, 0.0) if x is None or y is None or x != x or y != y else (0, abs(x - y))
    return sorted((i, j) for i, x in q for j, _ in sorted(r, key=lambda p: (far(x, p[1]), p[0]))[:k])


def check(spark, q, r, k, kind="bigint"):
    qs, rs = spark.createDataFrame(q, "q bigint, x double"), spark.createDataFrame(r, f"r {kind}, y double")
    assert sorted(map(tuple, nearest_k(qs, rs, "q", "x", "r", "y", k).collect())) == brute(q, r, k)


@pytest.mark.parametrize("n, values", [(400, 1000), (400, 12), (4, 9)])
def test_equals_brute_force(spark, n, values):
    rng = random.Random(n + values)
    q = [(i, rng.randrange(-5, values + 5) / 4) for i in range(60)]
    check(spark, q, [(i, rng.randrange(values) / 4) for i in rng.sample(range(9999), n)], 5)
    check(spark, q, [(f"{i}ä", rng.randrange(values) / 4) for i in rng.sample(range(9999), n)], 5, "string")


def test_nulls_are_farthest(spark):
    check(spark, [(1, None), (2, 1.0), (3, float("nan"))], [(9, None), (3, 2.0), (5, float("nan")), (7, 1.0)], 3)


def test_distances_that_round_to_the_same(spark):
    check(spark, [(1, -1e17), (2, 1e17), (3, 50.0)], [(500 - i, float(i)) for i in range(400)], 5)


def test_copies_of_queries_and_rows_meet_once(spark):
    """The answer is a join by value, no window over pairs of rows."""
    q, r = spark.range(300).select(F.col("id").alias("q"), (F.col("id") % 30).cast("double").alias("x")), spark.range(40_000).select(F.col("id").alias("r"), (F.col("id") % 200 / 4).alias("y"))
    got = nearest_k(q, r, "q", "x", "r", "y", 3)
    assert got.count() == 900 and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
