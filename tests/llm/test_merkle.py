"""The Merkle manifest against a plain tree: lone leaves, odd runs, nulls, repeated rows, groups of any height, tampering."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc, text, lang, source, n = row
    values = (doc, source, lang, None if n is None else n + more, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def ascend(tree, i, digest, proof):
    for level in tree[:-1]:
        other = level[i ^ 1] if i ^ 1 < len(level) else ""
        proof.append(other)
        digest = h(other, digest) if i % 2 else h(digest, other)
        i //= 2
    return digest


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in by.values():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in by[x]]) for x in langs]
    top = levels([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            proof, hit = [], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = ascend(top, k, ascend(trees[k], i, leaf(r, int(hit)), proof), proof)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit("own") for c in ("leaf", "tree", "idx", "root", "level")})
    return sorted((tuple(r) for r in merkle.prove(docs).collect()), key=str)


def rows_of(*sizes):
    langs = ["en", "fr", None, "é", "z", ""]
    return [(100 * k + i, f"text {i}\n é", langs[k], f"s{i % 3}", i) for k, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("levels_a_step, sizes", [(12, (1,)), (12, (5, 3, 1, 8, 17, 2)), (2, (1, 1)), (2, (5, 3, 1, 8, 17, 2)), (1, (9, 0, 4))])
def test_proofs_equal_a_plain_tree(spark, monkeypatch, levels_a_step, sizes):
    monkeypatch.setattr(merkle, "LEVELS", levels_a_step)
    rows = rows_of(*sizes)
    assert run(spark, rows) == plain(rows)


def test_nulls_repeated_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL_ROWS", 0)  # all joins by shuffles
    rows = rows_of(9, 2, 5) + [(None, None, None, None, None)] * 3 + [(None, "a", "en", None, 3), (4, "other", "en", None, None), (7, "", "fr", "", 2**63 - 1), (-3, "x" * 3_000_000, "fr", "s", 0)] + [rows_of(9)[4]] * 20
    got = run(spark, rows)
    assert got == plain(rows)
    assert all(r[6] for r in got if r[0] is None) and not all(r[6] for r in got)


def test_empty_table_and_settings(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert run(spark, []) == []
    assert run(spark, rows_of(3)) == plain(rows_of(3))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("merkle_")]


def test_more_leaves_than_the_engines_row_limit(spark):
    """Steps make more rows than the default limit of a recursive query."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "500")
    try:
        rows = [(i, None, "en" if i % 3 else "fr", None, i) for i in range(700)]
        assert run(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
