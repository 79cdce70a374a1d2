"""Decontamination against a plain scan: short items, overlaps, shared windows, blocks, nulls, copies, clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, held = words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if i + n <= len(w) and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    held |= {str(x) for x in windows[tuple(w[i : i + n])] if x is not None}
        out.append((doc, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit), tuple(sorted(hit))))
    return out


def corpus():
    rng = random.Random(7)
    vocabulary = ["alpha", "Beta", "gamma2", "Été", "ÉTÉ", "STRASSE", "ß", "日本", "x", "y_z", "İ", "Σας"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " -- "]) for _ in range(n))
    items = [(i, text(rng.choice([10, 12, 25, 40]))) for i in range(8)]
    items += [(20, "Short one"), (21, "short ONE"), (22, None), (23, " ... "), (100, items[0][1]), (9, items[0][1]), (None, "no name here"), (24, "one two three four five six seven eight nine")]
    docs = [(i, text(rng.randint(0, 80))) for i in range(40)]
    for i, (_, t) in enumerate(items):
        docs.append((100 + i, text(5) + (t or "") + " " + text(5) + (t or "")[: rng.randint(0, 200)]))
    docs += [(200, None), (201, ""), (202, "?!"), (203, items[1][1] + " " + items[1][1]), (203, items[1][1] + " " + items[1][1]), (None, items[1][1].upper()), (204, "a short; one! (NO name HERE)")]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("own") for c in ("digest", "pos", "n_hit", "spans", "w", "n_words")})
    return sorted((tuple(r) for r in dc.report(d, frame(spark, items)).collect()), key=str)


def frame(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string").withColumn("window", F.lit("own"))


@pytest.mark.parametrize("block, small", [(32 << 20, 100_000), (300, 0)])
def test_report_equals_a_plain_scan(spark, monkeypatch, block, small):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    monkeypatch.setattr(dc, "SMALL_ROWS", small)
    docs, items = corpus()
    assert run(spark, docs, items) == sorted((r[:6] for r in plain(docs, items)), key=str)


def test_empty_tables(spark):
    docs, items = corpus()
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == sorted((r[:6] for r in plain(docs, [])), key=str)


def test_spans_and_documents_are_removed(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"n_hit": F.lit("own"), "_x": F.lit(1)})
    truth = plain(docs, items)
    kept = dc.drop_documents(d, frame(spark, items))
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in truth if not r[5])
    most = dc.drop_documents(d, frame(spark, items), 3)
    assert sorted(str(r.doc_id) for r in most.collect()) == sorted(str(r[0]) for r in truth if r[2] <= 3)
    cleaned = dc.remove_spans(d, frame(spark, items))
    assert cleaned.columns == d.columns
    want = []
    for (doc, text), r in zip(docs, truth):
        if r[5]:
            at = [m.end() for m in WORD.finditer(text)]
            pieces = [text[a:b] for a, b in zip([0, *at], at)]
            text = "".join(p for i, p in enumerate(pieces) if i not in r[6]) + text[at[-1] :]
        want.append((str(doc), text))
    assert sorted(((str(r.doc_id), r.text) for r in cleaned.collect()), key=str) == sorted(want, key=str)


def test_a_long_text_and_a_hot_window(spark):
    """A text of 400,000 words with one passage, and a passage that every document and every item holds."""
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(i, f"{i} {passage} {i}") for i in range(300)] + [(900, "word " * 400_000 + passage + " word" * 20)]
    items = [(i, f"{passage} item {i}") for i in range(40)]
    got = {r[0]: r for r in run(spark, docs, items)}
    assert all(got[i][2:4] == (11, 40) for i in range(300))
    assert got[900][1:4] == (400_031, 11, 40)
