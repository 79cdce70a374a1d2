"""The registered queries of fits and calibrations, collected: no SQL states them, so their rows are held against what must hold of any."""

import os

import pytest

from tidemark.operators import forecast as fc
from tidemark.plans.all_queries import QUERIES
from tidemark.plans.forecast import PS, folds, given_probabilities
from tidemark.plans.registry import Tables

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", ["m6_logistic", "m7_linear", "m9_hurdle", "m29_quantile_boosting"])
def test_fits_of_every_fold(spark, name):
    got = QUERIES[name](spark, DIR).collect()
    asked = {(r.fold, r.series_id, r.week) for r in folds(Tables(spark, DIR)).where("role = 'TEST'").collect()}
    assert len(got) == len(asked) and {(r.fold, r.series_id, r.week) for r in got} == asked
    assert {r.fold for r in got} == set(range(1997, 2001))  # every year with two before it
    for r in got:
        ps = [r[p] for p in PS]
        if None not in ps:
            assert abs(sum(ps) - 1) < 1e-9 and all(0 <= p <= 1 for p in ps), r
    assert sum(r.p_up is not None for r in got) > 0.9 * len(got)


def test_boosted_probabilities(spark):
    got = QUERIES["m8_boosted"](spark, DIR).collect()
    assert got and all(0 <= r.p_move <= 1 for r in got)


@pytest.mark.parametrize("name", ["m10_platt", "m11_isotonic"])
def test_calibrations_with_a_fold_without_rows_to_fit_on(spark, name):
    given = {r.row_id: r for r in given_probabilities(Tables(spark, DIR)).where("role = 'TEST'").collect()}
    got = QUERIES[name](spark, DIR).collect()
    assert {r.row_id for r in got} == given.keys() and len(got) == len(given)
    first = min(r.fold for r in got)
    for r in got:
        ps = [r[p] for p in PS]
        assert all(isinstance(p, float) and 0 <= p <= 1 for p in ps) and abs(sum(ps) - 1) < 1e-9
        if r.fold == first:  # no earlier year to calibrate on: as given
            assert ps == [given[r.row_id][p] for p in PS]
    assert any([r[p] for p in PS] != [given[r.row_id][p] for p in PS] for r in got)


def test_folds_may_name_columns_in_any_order(spark):
    rows = spark.createDataFrame([(1, "TEST", 1.0, "x"), (2, "TEST", 2.0, "y")], "fold int, role string, p double, truth string")
    turn = iter([["p", "truth"], ["truth", "p"]])
    got = fc.per_fold(rows, lambda train, cal, test: test.select(*next(turn))).collect()
    assert sorted((r.p, r.truth) for r in got) == [(1.0, "x"), (2.0, "y")]
