"""Shards against a plain version: rank in the source, sort by fractional rank, cut."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding


def plain(rows, shards):
    """(doc_id, shard, slot) of rows (doc_id, source, no_source, text_key, row_key), in cells as the operator's order has them."""
    side = sharding.LEAST_SIDE
    cell = lambda key: (key % (1 << 64) >> 40) % side
    by = {}
    for r in rows:
        by.setdefault(r[1:3], []).append(r)
    placed = []
    for own in by.values():
        own.sort(key=lambda r: (cell(r[3]), cell(r[4]), r[3], r[4], r[0] is not None, r[0]))
        placed += [((i + 0.5) / len(own), r) for i, r in enumerate(own)]
    placed.sort(key=lambda x: (x[0], x[1][1], x[1][2], x[1][4], x[1][0] is not None, x[1][0]))
    base, more = divmod(len(rows), shards)
    out, at = [], 0
    for k in range(shards):
        n = base + (k < more)
        out += [(r[0], k, i) for i, (_, r) in enumerate(placed[at : at + n])]
        at += n
    return out


@pytest.mark.parametrize(("n", "per_cell"), [(5, 20_000), (777, 20_000)])
def test_equals_a_plain_version(spark, monkeypatch, n, per_cell):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", per_cell)
    rows = [(i, f"text {i % 90}" if i % 13 else None, None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 7}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", F.coalesce("source", F.lit("")), F.col("source").isNull(), F.xxhash64(text, F.lit(42)), F.xxhash64("doc_id", text, F.lit(42)))
    got = sorted((r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs, 40).collect())
    assert got == sorted(plain([tuple(r) for r in keys.collect()], 40))


def test_more_cells_give_whole_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 0.01)
    docs = spark.range(500).selectExpr("id AS doc_id", "cast(id AS string) AS text", "'one' AS source")
    got = sharding.interleave(docs, 7).collect()
    assert sorted(r.doc_id for r in got) == list(range(500))
    for k in range(7):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots))) and len(slots) in (71, 72)
