"""Quality scores learned from preference pairs (Bradley-Terry), with a threshold by score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches, runs, texts_of
from .features import NAMES, text_features

#: Labelled documents that the fit takes, chosen by a hash of their id; about as many are collected, as len(NAMES) numbers each.
FIT_ROWS = 20_000
#: Preference pairs that each document of the rarer label is part of, and all pairs at most.
PAIRS_PER_ROW, MOST_PAIRS = 40, 400_000
QUANTILES = 400
ACCEPTED = 0.7


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; ACCEPTED at the threshold."""
        z = (self.margin(x) - self.threshold) / self.spread + np.log(ACCEPTED / (1 - ACCEPTED))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expand(z: np.ndarray) -> np.ndarray:
    """Standard values, clipped, and how far each is above the mean: both ends of a feature may count."""
    z = np.clip(z, -4, 4)
    return np.concatenate([z, np.abs(z)], axis=1)


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 7) -> QualityModel:
    """Bradley-Terry fit: P(good before bad) = 1 / (1 + exp(-(s(good) - s(bad)))), s linear in the features.

    With one label only there are no pairs; then every text scores the share of
    label 1 that was seen (0 or 1), and with no labels at all 0.5.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = 2 * len(NAMES)
    if not len(good) or not len(bad):
        shift = 0.0 if not len(y) else (20.0 if len(good) else -20.0)
        return QualityModel(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(d), np.log(ACCEPTED / (1 - ACCEPTED)) - shift, 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = expand((x - mean) / scale)
    rng = np.random.default_rng(seed)
    n = min(PAIRS_PER_ROW * min(len(good), len(bad)), MOST_PAIRS)
    diff = z[rng.permutation(np.resize(good, n))] - z[np.resize(bad, n)]
    w = np.zeros(d)
    for _ in range(40):  # Newton steps for the logistic loss with a small ridge
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / n + 1e-3 * np.eye(d), diff.T @ (1 - p) / n - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # the score quantile that tells the labels best, each label weighing the same; of equally good ones the middle
    cuts = np.quantile(s, np.linspace(0, 1, QUANTILES + 1))
    cuts = (cuts[1:] + cuts[:-1]) / 2
    right = (s[good][:, None] >= cuts).mean(axis=0) + (s[bad][:, None] < cuts).mean(axis=0)
    best = cuts[right >= right.max() - 1e-12]
    # where labels are apart, the middle of the gap
    t = (best[0] + best[-1]) / 2
    below, above = s[s < t], s[s >= t]
    if len(below) and len(above):
        t = (below.max() + above.min()) / 2
    return QualityModel(mean, scale, w, float(t), float(max(s.std() / 4, 1e-6)))


def held_out(doc_id: str = "doc_id"):
    """Whether the fit must not see a document; a null id is not held out (and not learned from either)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(docs: DataFrame, keep: str) -> DataFrame:
    def run(batch: dict) -> Iterator[dict]:
        text, key = texts_of(batch["text"]), batch[keep].to_pylist()
        for a, b in runs(text):
            yield {keep: key[a:b], "features": list(text_features(text[a:b]))}

    return map_batches(docs.select(keep, "text"), run, f"{keep} int, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
    """Fit on labelled documents that are not held out, about `rows` of them.

    Null ids and labels are left out; of several labels of a document the least counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    # at most about `rows` ids, so they may be sent to every task
    got = features(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("label", "text"), "label").toPandas()
    x = np.array(got["features"].tolist(), float).reshape(-1, len(NAMES))
    y = got["label"].to_numpy(int)
    order = np.lexsort((*x.T, y))  # the fit must not depend on the order of rows
    return fit_pairs(x[order], y[order])


def score_documents(docs: DataFrame, model: QualityModel, extra: tuple[str, ...] = ()) -> DataFrame:
    """Score of every row's whole text; a null text is an empty one. predicted is 1 from ACCEPTED on. Columns named in extra are kept."""
    from pyspark.sql.types import StructType

    def run(batch: dict) -> Iterator[dict]:
        text = texts_of(batch["text"])
        kept = {c: batch[c].to_pylist() for c in ("doc_id", *extra)}
        for a, b in runs(text):
            s = model.score(text_features(text[a:b]))
            yield {c: v[a:b] for c, v in kept.items()} | {"score": s, "predicted": (s >= ACCEPTED).astype(np.int32)}

    cols = list(dict.fromkeys(["doc_id", "text", *extra]))
    kinds = StructType([docs.schema[c] for c in dict.fromkeys(["doc_id", *extra])])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    return map_batches(docs.select(*cols), run, ddl + ", score double, predicted int")
