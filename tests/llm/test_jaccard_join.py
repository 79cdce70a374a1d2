import itertools
import random

import numpy as np
import pytest

from tidemark.llm import jaccard_join as jj
from tidemark.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(rows):
    def shingle(text):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingle(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 12, 20, 40, 90, 300]))]
            if kind > 0.8:
                w = passage + w
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "common"), [(1, 4), (2, 1), (3, 64)])
def test_equals_brute_force(spark, seed, common):
    rows = corpus(seed, 220)
    got = jj.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), common=common).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_nulls_empty_texts_case_and_clashing_columns(spark):
    long = "One two three FOUR five six seven"
    rows = [(5, None, "x", "s", 1), (4, "", "x", "s", 1), (3, " \t\n ", None, None, None), (2, long.lower(), "x", "s", 1), (1, long, "x", "s", 1), (7, "a b", "x", "s", 1), (6, "A  B", "x", "s", 1), (None, long, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "component_id").withColumnRenamed("lang", "key").withColumnRenamed("source", "band")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jj.similar_groups(df).collect()}
    assert got == {(5, 0): 5, (4, 0): 4, (3, 0): 3, (2, 3): 1, (1, 3): 1, (7, 1): 6, (6, 1): 6, (None, 3): None}
    kept = jj.first_of_groups(df)
    assert kept.columns == df.columns and kept.count() == 6


def test_empty_table(spark):
    assert jj.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size", [4, 5, 9, 17, 30, 60, 120, 400])
def test_linked_sets_share_a_key(size):
    """Any pair at the limit of the similarity has a common signature in a band of both."""
    rng = np.random.default_rng(size)
    for _ in range(30):
        s = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        r, n = s.copy(), len(s)
        while True:  # take out and put in elements for as long as the sets link
            t = r[np.arange(len(r)) != rng.integers(len(r))] if rng.random() < 0.5 else np.union1d(r, rng.integers(0, 1 << 63, 1).astype(np.uint64))
            k = len(np.intersect1d(s, t))
            if 100 * k < 80 * (n + len(t) - k):
                break
            r = t
        common = set(jj.bands_of(len(r))) & set(jj.bands_of(n))
        assert any(np.intersect1d(jj.signatures(r, k), jj.signatures(s, k)).size for k in common)


def test_components_of_a_chain_a_star_and_null_ends(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (200, 150)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 150: 150, 200: 150}
