"""Fingerprints, quality, language, tokens, packing and shards."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, fingerprints, language_id, packing, quality, sharding
from tidemark.llm.queries import table

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "a  b   c", "x\n  y <|endoftext|>z<|startoftext|>", "ΣΑΣ ΌΔΟΣ İstanbul é \u0085x\x1cy", "a" * 3000, "don't I'll 12345 ½ ٣", "  lead", "trail  ", "日本語 テキスト😀😀", "nul\0 in\0text", "word " * 3000, "x" * 7000 + " y"]


def shingle(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints_estimate_the_similarity(spark):
    docs = table(spark, SF, "documents")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(text, reverse=True)
    error = []
    for r in fingerprints.edit_likeness(docs).collect():
        t, n = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b = shingle(t), shingle(e)
        if len(a | b) > 50:
            error.append(r.near_edited - len(a & b) / len(a | b))
    assert np.abs(error).max() < 0.09 and abs(np.mean(error)) < 0.01


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "z " * 9), (4, "same text of five words"), (5, "same text of five words")]
    got = fingerprints.edit_likeness(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fingerprint", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[4].fingerprint == by[5].fingerprint and by[5].near_next == 1.0
    assert by[1].fingerprint == by[2].fingerprint == "" and by[2].near_next == 1.0
    assert fingerprints.edit_likeness(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_fingerprints_of_texts_are_packed_low_bits():
    rows = fingerprints.signatures(["a b c d e f g", "", "a"])
    assert [len(x) for x in fingerprints.packed(rows)] == [fingerprints.BINS * fingerprints.BITS // 4, 0, fingerprints.BINS * fingerprints.BITS // 4]


def test_quality_on_documents_that_are_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    scored = quality.score_documents(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out())
    n, right = scored.agg(F.count(F.lit(1)), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n > 50 and right / n > 0.95


def test_quality_with_few_labels_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "Fine words here.", "s"), (None, "x", "s"), (3, "Fine words here.", "s")], "doc_id bigint, text string, score string")
    for labels, low, high in (([], 0.5, 0.5), ([(3, 1, 0), (None, 1, 0), (2, None, 0)], 0.7, 1.0)):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        got = quality.score_documents(docs.drop("score"), model).collect()
        assert len(got) == 5 and all(low <= r.score <= high for r in got)


def test_language_on_documents_that_are_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify(docs, language_id.fit(docs), ("lang",)).where(language_id.held_out())
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert n > 200 and right / n > 0.98


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (3, "the cat", "en"), (6, "la casa", None), (None, "x", "en"), (9, "der hund", "de")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = docs.limit(0)
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0


def test_word_bpe_equals_the_library(spark):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    lib = Tokenizer.from_file(path)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (98, "a"), (98, "a")]
    for r in bpe.encode_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), path, with_ids=True).collect():
        ids = lib.encode(dict(docs)[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_packing_is_whole_gapless_and_tight(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(path)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, "twice"), (51, "twice"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("length", F.lit("x"))
    got = packing.pack_documents(df, path).collect()
    want = Counter()
    for i, t in docs:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_best_fit_against_a_plain_one():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 2049, 400)
    got = packing.best_fit(sizes, 2048)
    rooms = []
    for s in sorted(sizes.tolist(), reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(2048 - s)
    assert np.bincount(got, weights=sizes).max() <= 2048 and got.max() + 1 == len(rooms)


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 1003])
def test_shards_are_even_and_keep_the_mixture(spark, n):
    rows = [(i if i % 50 else None, f"t{i % 300}" if i % 11 else None, None if i % 7 == 0 else f"s{min(i % 9, 3)}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("rank", F.lit(1)).withColumn("hi", F.lit(2))
    got = sharding.interleave(df, 40).collect()
    assert len(got) == n and all(r["size"] == len((dict.fromkeys([r.doc_id]) and (next(t for d, t, s in rows if d == r.doc_id) or "")).encode()) + 16 for r in got if r.doc_id is not None)
    sizes = Counter(r.shard for r in got)
    if n >= 40:
        assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(c)) for k, c in sizes.items())
    if n > 1000:
        for s in {r.source for r in got}:
            per = [sum(r.source == s for r in got if r.shard == k) for k in range(40)]
            assert max(per) - min(per) <= 4  # small sources may fall in step
