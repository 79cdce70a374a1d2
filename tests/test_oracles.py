"""Every query with SQL, run on the smallest tables, against DuckDB."""

import os

import duckdb
import pytest

from tidemark.plans.all_queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each family; the driver runs all of them.
CHOSEN = [
    "flagship_forecast_scores", "j3_asof_backward", "j5_pit_latest", "j6_pit_anchor", "a1_weekly_bars", "a9_metrics_by_year", "w3_rolling_std", "w4_calendar_std", "d5_walk_forward", "d12_non_overlapping",
    "m14_reliability", "m19_bootstrap_cluster", "e2_event_rules", "e15_validate_reasons", "f20_round_to_100", "p2_quarantine", "l4_nearest_k", "s13_publish_current", "st3_weekly_bars", "st7_outcomes",
]


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple(map(str, r))
    ours = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=key)
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert ours == theirs


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(ORACLES) == {"e6_dedup_multi", "m6_logistic", "m7_linear", "m8_boosted", "m9_hurdle", "m10_platt", "m11_isotonic", "m29_quantile_boosting", "st2b_first_wins", "st8_freshness_machine"}
