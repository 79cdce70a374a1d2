"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import map_batches, mix, runs, shingles, texts_of

BINS = 1024
BITS = 4
#: Ranges of doc_id for each shuffle partition, and ranges in all at most; each range is one window.
RANGES_PER_PARTITION, MOST_RANGES, NULL_RANGES = 4, 20_000, 64


#: Up to so many filled bins, an empty bin looks its donor up among them; beyond, it tries one bin after the other.
FEW = 48
_orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def donor_orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin a random order of all bins, the same for all texts, and the place of each bin in it."""
    if bins not in _orders:
        at = np.arange(bins, dtype=np.uint64)
        order = np.argsort(mix(at[:, None] * np.uint64(1 << 32) + at), axis=1)
        _orders[bins] = order.astype(np.int32), np.argsort(order, axis=1).astype(np.int32)
    return _orders[bins]


def signatures(texts: list[str], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Low `bits` bits of the least shingle hash of each bin, one row per text, as bytes below 16; 255 in all bins of a text without words.

    A shingle's high hash bits choose its bin. An empty bin takes the value of
    the first filled bin in a random order of its own, which is the same for
    all texts.
    """
    out = np.full((len(texts), bins), 255, np.uint8)
    shift = np.uint64(64 - (bins.bit_length() - 1))
    order, place = donor_orders(bins)
    many = np.zeros(len(texts), bool)
    for i, s in enumerate(shingles(texts)):
        if len(s):
            s = np.sort(s)  # by bin, and within a bin by value
            b = (s >> shift).astype(np.int64)
            first = np.flatnonzero(np.diff(b, prepend=-1))
            own = out[i]
            own[b[first]] = (mix(s[first]) & np.uint64((1 << bits) - 1)).astype(np.uint8)
            if len(first) <= FEW:
                empty = np.flatnonzero(own == 255)
                own[empty] = own[b[first]][place[np.ix_(empty, b[first])].argmin(axis=1)]
            else:
                many[i] = True
    rows = np.flatnonzero(many)
    for a in range(0, len(rows), 256):
        some = out[rows[a : a + 256]]
        flat, donors = some.ravel(), order.ravel()
        empty = np.flatnonzero(flat == 255)
        row, cell = empty - empty % bins, (empty % bins) * bins
        filled, attempt = flat.copy(), 0
        while len(empty):
            got = filled[row + donors[cell + attempt]]
            left = got == 255
            flat[empty[~left]] = got[~left]
            empty, row, cell, attempt = empty[left], row[left], cell[left], attempt + 1
        out[rows[a : a + 256]] = some
    return out


def packed(rows: np.ndarray, bits: int = BITS) -> list[str]:
    """Hexadecimal text of each row's low bits; empty for a text without words."""
    wide = np.unpackbits(rows[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(rows), -1)
    return ["" if r[0] == 255 else p.tobytes().hex() for r, p in zip(rows, np.packbits(wide, axis=1))]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of rows, less what unequal values agree on by chance. Two texts without words are alike, one is like none."""
    chance = 1 / (1 << bits)
    got = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    got[(a[:, 0] == 255) & (b[:, 0] == 255)] = 1.0
    return got


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row; texts are whole, null ones empty, repeated rows stay."""

    def run(batch: dict) -> Iterator[dict]:
        doc, text = batch["doc_id"].to_pylist(), texts_of(batch["text"])
        for a, b in runs(text):
            yield {"doc_id": doc[a:b], "n_chars": list(map(len, text[a:b])), "fingerprint": packed(signatures(text[a:b]))}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_chars bigint, fingerprint string")


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the row that follows by descending doc_id; the first row's after the last.

    Null ids come last, in NULL_RANGES ranges by a hash of their text; they have no
    order of their own. Equal ids follow each other by that hash. Other ids are cut into
    ranges by their quantiles, so that no task orders more than its range; the
    first row of each range is also dealt to the range before it.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = min(RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    edges = np.unique(np.array(cuts, np.int64))

    # Range 0 has the largest ids, then they get smaller; the last ones have null ids.
    @F.pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        none = ids.isna()
        found = len(edges) - np.searchsorted(edges, ids.fillna(0).astype("int64").to_numpy(), side="right")
        return pd.Series(np.where(none, len(edges) + 1 + hashes.to_numpy() % NULL_RANGES, found).astype("int32"))

    ranged = docs.withColumn("h", F.xxhash64("text")).withColumn("r", range_of("doc_id", "h"))
    # a row's place in its range: by id, then by the hash of its text, which is as good an order as any
    top = F.max(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), -F.col("h").cast("decimal(20,0)"))).alias("top")
    tops = {x["r"]: (x["top"][0], -int(x["top"][1])) for x in ranged.groupBy("r").agg(top).collect()}  # a row per range
    if not tops:
        return docs.withColumn("next_text", F.lit(""))
    order = np.array(sorted(tops), np.int32)
    before, top_id, top_hash = np.roll(order, 1), np.array([tops[r][0] for r in order]), np.array([tops[r][1] for r in order])

    # The range that a row must be dealt to besides its own, if it may be the first one of its own.
    @F.pandas_udf("int")
    def also(r: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        at = np.searchsorted(order, r.to_numpy())
        is_top = (ids.fillna(0).astype("int64").to_numpy() == top_id[at]) & (hashes.to_numpy() == top_hash[at])
        return pd.Series(np.where(is_top, before[at], -1).astype("int32"))

    at = F.struct("r", F.lit(0).alias("more"))
    dealt = ranged.withColumn("to", also("r", "doc_id", "h"))
    dealt = dealt.select("doc_id", "text", "h", F.explode(F.when(F.col("to") >= 0, F.array(at, F.struct(F.col("to").alias("r"), F.lit(1).alias("more")))).otherwise(F.array(at))).alias("at"))
    w = Window.partitionBy("at.r").orderBy("at.more", F.desc_nulls_last("doc_id"), "h")
    return dealt.withColumn("next_text", F.lead("text").over(w)).where("at.more = 0").select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with the likeness to it and to the next document.

    The edited text has its last floor(n_chars / 3) code points replaced by as
    many from the beginning of the next document (or all that it has).
    """

    def run(batch: dict) -> Iterator[dict]:
        doc, text, following = batch["doc_id"].to_pylist(), texts_of(batch["text"]), texts_of(batch["next_text"])
        for a, b in runs(text):
            t, n = text[a:b], following[a:b]
            edited = [x[: len(x) - len(x) // 3] + y[: len(x) // 3] for x, y in zip(t, n)]
            own = {x: i for i, x in enumerate(dict.fromkeys(t + n))}  # most next texts are texts of the batch
            rows = signatures(list(own))
            mine, theirs = rows[[own[x] for x in t]], rows[[own[x] for x in n]]
            changed = signatures(edited)
            yield {
                "doc_id": doc[a:b],
                "n_chars": list(map(len, t)),
                "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                "fingerprint": packed(mine),
                "edited_fingerprint": packed(changed),
                "near_edited": likeness(mine, changed),
                "near_next": likeness(mine, theirs),
            }

    return map_batches(with_next_text(docs), run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
