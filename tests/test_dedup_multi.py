"""Greedy deduplication over several keys: long chains, repeated and null ids, and the keys of e6."""

from tidemark.operators.evidence import dedup_multi
from tidemark.plans.all_queries import QUERIES


def fold(rows):
    seen, kept = set(), []
    for i, *ks in rows:
        own = {(n, k) for n, k in enumerate(ks) if k is not None} | {("id", i)}
        if not own & seen:
            kept.append(i)
            seen |= own
    return kept


def test_chain_of_alternating_keys_loses_no_row(spark):
    rows = [(i, i // 2, (i + 1) // 2) for i in range(124)]
    got = dedup_multi(spark.createDataFrame(rows, "id int, p int, q int").coalesce(1), ["p", "q"], ["id"], "id")
    assert sorted(r.id for r in got.collect()) == fold(rows) == list(range(0, 124, 2))


def test_repeated_and_null_ids_end(spark):
    rows = [(1, 1, "a", None), (1, 2, "a", "x"), (2, 3, "b", "x"), (None, 4, "c", "y"), (3, 5, "c", None), (4, 6, None, None)]
    got = dedup_multi(spark.createDataFrame(rows, "id int, at int, p string, q string"), ["p", "q"], ["at"], "id")
    assert sorted((r.id for r in got.collect()), key=str) == sorted(fold([(i, p, q) for i, _, p, q in rows]), key=str) == [1, 2, 4, None]


def test_e6_keeps_texts_that_only_open_alike(spark, tmp_path):
    opening = "This passage may be copied under the terms of a license. " * 2
    rows = [(1, opening + "One", "s"), (2, opening + "Two", "s"), (3, opening + "One", "t"), (4, opening + "One", "s"), (5, opening + "\n\n  One ", "s"), (6, opening + "\nOne", "s"), (7, None, "s"), (8, "", "s"), (9, "x", None), (10, "x", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in QUERIES["e6_dedup_multi"](spark, str(tmp_path)).collect()) == [1, 2, 3, 5, 7, 9]
