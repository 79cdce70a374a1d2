"""The Jaccard join on one large group of near copies, many of which link with none."""

import random

import pytest
from test_jaccard_join import brute

from tidemark.llm import jaccard_join as jj
from tidemark.llm.differences import differences


def near_copies(seed, n, words=60):
    """Copies of one text with words replaced, deleted or put in, some near enough to it, some not, and some near to those."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)]
    first = [rng.choice(vocabulary) + f"x{i}" for i in range(words)]
    rows, texts = [(0, " ".join(first))], [first]
    for i in range(1, n):
        w = list(first if rng.random() < 0.8 else rng.choice(texts))
        for _ in range(rng.randint(0, 6)):
            at, kind = rng.randrange(len(w)), rng.random()
            w[at : at + 1] = [] if kind < 0.4 else [rng.choice(vocabulary)] if kind < 0.8 else [w[at], rng.choice(vocabulary)]
        texts.append(w)
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "words"), [(1, 60), (2, 25), (3, 140)])
def test_hot_group_equals_brute_force(spark, seed, words):
    rows = near_copies(seed, 500, words)
    want = brute(rows)
    alone = sum(1 for i, (_, c) in want.items() if c == i)
    assert alone > 10 and max(want.values(), key=lambda x: x[1])[1] > 0
    got = jj.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_higher_similarity_around_leads(spark):
    """At 90 % a document may link with the lead at 80 % only, and still with another that does so too."""
    rows = near_copies(5, 200, 90)
    sets = {i: set(next(jj.shingle_sets([t])).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = jj.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=90).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in sets}


def test_differences_are_symmetric_ones(spark):
    rows = near_copies(7, 12)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: set(next(jj.shingle_sets([t])).astype("int64").tolist()) for i, t in rows}
    got = {}
    for r in differences(spark.createDataFrame([(0, i) for i in range(1, 12)], "lead bigint, doc_id bigint"), docs).collect():
        got.setdefault(r.doc_id, set()).add(r.x)
        assert (r.d, r["size"], r.lead_size) == (len(sets[r.doc_id] ^ sets[0]), len(sets[r.doc_id]), len(sets[0]))
    assert got == {i: sets[i] ^ sets[0] for i in range(1, 12) if sets[i] != sets[0]}
