"""The Bradley-Terry fit and its threshold against plain versions: gradient steps on the loss, and a search over all cuts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, quality
from tidemark.llm.features import NAMES


def sample(n=400, seed=0, noise=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(NAMES)))
    y = (x[:, 0] - 0.7 * x[:, 1] + noise * rng.normal(size=n) > 0.3).astype(int)
    return x, y


def plain_fit(x, y, steps=20_000, rate=0.5):
    """Every pair of a good and a bad text, the logistic loss of the difference of their scores, and the ridge, by plain gradient steps."""
    z = np.clip((x - x.mean(0)) / x.std(0), -4, 4)
    z = np.concatenate([z, np.abs(z)], axis=1)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        step = diff.T @ (1 / (1 + np.exp(diff @ w))) / len(diff) - 1e-3 * w
        w += rate * step
        if np.abs(step).max() < 1e-5:
            break
    return w, z @ w


def order_agreement(a, b):
    i, j = np.triu_indices(len(a), 1)
    return (np.sign(a[i] - a[j]) == np.sign(b[i] - b[j])).mean()


def test_fit_ranks_as_a_plain_fit_of_all_pairs():
    x, y = sample(160)
    model = quality.fit_pairs(x, y)
    w, s = plain_fit(x, y)
    ours = model.margin(x)
    assert np.corrcoef(ours, s)[0, 1] > 0.97 and order_agreement(ours, s) > 0.92
    auc = lambda v: (v[y == 1][:, None] > v[y == 0][None]).mean()
    assert abs(auc(ours) - auc(s)) < 0.02


@pytest.mark.parametrize("noise", [0.0, 0.5, 2.0])
def test_threshold_tells_labels_as_well_as_any_cut(noise):
    x, y = sample(600, 3, noise)
    model = quality.fit_pairs(x, y)
    s = model.margin(x)
    right = lambda t: (s[y == 1] >= t).mean() + (s[y == 0] < t).mean()
    best = max(right(t) for t in np.concatenate([s, [s.max() + 1]]))
    assert right(model.threshold) >= best - 2 / quality.QUANTILES * 2
    score = model.score(x)
    assert ((score >= quality.ACCEPTED) == (s >= model.threshold)).all() and (np.diff(score[np.argsort(s)]) >= 0).all()


def test_fit_is_the_loss_minimum_of_its_pairs():
    """Newton's steps end where the gradient of the loss on the drawn pairs is zero."""
    x, y = sample(300, 5)
    model = quality.fit_pairs(x, y)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = min(quality.PAIRS_PER_ROW * min(len(good), len(bad)), quality.MOST_PAIRS)
    z = quality.expand((x - model.mean) / model.scale)
    diff = z[np.random.default_rng(7).permutation(np.resize(good, n))] - z[np.resize(bad, n)]
    gradient = diff.T @ (1 / (1 + np.exp(diff @ model.weights))) / n - 1e-3 * model.weights
    assert np.abs(gradient).max() < 1e-6


def test_labels_of_any_type_and_missing_components(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a"), (3, [1.0, 2.0], "b"), (4, [1.0, None], "a"), (5, None, "a"), (6, [2.0, 4.0], "a"), (7, [1.0, 2.0, 0.0], "a"), (8, [], "a"), (9, [3.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string")
    want = {1: (2, 1), 2: (2, 1), 6: (2, 1)} | {i: (0, i) for i in (3, 4, 5, 7, 8, 9)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} == want
    big = df.withColumn("label", F.when(F.col("label") == "a", F.lit(2**40)).when(F.col("label") == "b", F.lit(1)))
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(big).collect()} == want
