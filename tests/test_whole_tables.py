"""Queries that must take their whole tables, against DuckDB and by count."""

import os

import duckdb
import pytest

from tidemark.plans.all_queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
ITEM_COUNTS = "SELECT sum(least(len(regexp_extract_all(html, '<p[^>]*>(.*?)</p>', 1, 's')), {})) FROM pages"


@pytest.mark.parametrize("name, rows", [("e15_validate_reasons", "SELECT count(*) FROM events"), ("s9_feed_items", ITEM_COUNTS.format(30)), ("s9_sitemap_items_200", ITEM_COUNTS.format(200))])
def test_query_takes_all_rows_and_equals_sql(spark, name, rows):
    duck = duckdb.connect()
    for t in ("events", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, rel = QUERIES[name](spark, DIR), duck.sql(ORACLES[name])
    assert df.columns == rel.columns
    ours = sorted((tuple(r) for r in df.collect()), key=str)
    assert ours == sorted(rel.fetchall(), key=str)
    assert len(ours) == duck.sql(rows).fetchall()[0][0]
