"""Ranked search against a plain scorer: ties, nulls, repeated rows, shards and blocks of any size, long texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in bags:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if c[t])
            if s > 0:
                scores.append((-s, d is not None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÇA", "naïve", "日本語", "😀", "A1", "b_c"]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 60)))
    docs = [(i, text()) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(30)] + [(n + 40, None), (n + 41, ""), (n + 42, "!! __ .."), (None, docs[3][1]), (5, docs[5][1]), (n + 43, docs[3][1].upper())]
    items = [(i, text()) for i in range(12)] + [(50, None), (51, ""), (52, "absent words only"), (0, None), (53, docs[3][1]), (53, docs[3][1])]
    return docs, items


def run(spark, docs, items, k=10, parts=3):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts).withColumns({c: F.lit("own") for c in ("n", "score", "item", "rank", "term_ids")})
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit("own") for c in ("item", "rank", "doc_id")})
    return sorted((tuple(r) for r in rs.search(d, q, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("shard, block", [(50_000, 200_000), (7, 200_000), (50_000, 25)])
def test_search_equals_a_plain_scorer(spark, monkeypatch, shard, block):
    monkeypatch.setattr(rs, "SHARD_DOCS", shard)
    monkeypatch.setattr(rs, "BLOCK_TERMS", block)
    docs, items = corpus()
    assert run(spark, docs, items) == plain(docs, items)


def test_k_and_empty_tables(spark):
    docs, items = corpus(40, 2)
    assert run(spark, docs, items, 3) == plain(docs, items, 3)
    assert run(spark, docs, items, 1000) == plain(docs, items, 1000)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [], []) == []
    assert run(spark, [(1, None)], items) == []


def test_long_and_frequent(spark):
    """One document of a million terms, one term in every document, and a third of all documents alike."""
    rng = random.Random(4)
    docs = [(i, "the same text of many") for i in range(100)] + [(200 + i, "the " + " ".join(f"w{rng.randrange(50)}" for _ in range(20))) for i in range(200)] + [(999, " ".join(f"w{i % 50}" for i in range(1_000_000)))]
    items = [(1, "the same w1 w2"), (2, "w49 many the"), (3, "the")]
    assert run(spark, docs, items) == plain(docs, items)


def test_bounds_end_before_the_lists_do():
    """NRA itself, on lists of any kind: the same as a full sum, and lists of what cannot matter stay unread."""
    rng = np.random.default_rng(3)
    for trial in range(60):
        n, k = int(rng.integers(1, 200)), int(rng.integers(1, 12))
        lists = []
        for _ in range(int(rng.integers(1, 8))):
            docs = rng.permutation(n)[: int(rng.integers(1, n + 1))]
            worth = np.sort(rng.integers(0, 5 if trial % 2 else 10_000, len(docs)))[::-1].astype(np.int64)
            lists.append((docs, worth))
        total = np.zeros(n, np.int64)
        for docs, worth in lists:
            total[docs] += worth
        best, scores = rs.nra(lists, n, k, np.arange(n))
        want = sorted((-s, i) for i, s in enumerate(total) if s > 0)[:k]
        assert list(zip((-scores).tolist(), best.tolist())) == want

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counted.read += len(range(*at.indices(len(self))))
            return super().__getitem__(at)

    high = (np.arange(20), np.full(20, 10**6))
    low = (np.arange(100_000).view(Counted), np.arange(100_000, 0, -1) // 1000)
    assert rs.nra([(high[0], high[1] + np.arange(20)[::-1]), low], 100_000, 5, np.arange(100_000))[0].tolist() == [0, 1, 2, 3, 4]
    assert Counted.read < 10_000
