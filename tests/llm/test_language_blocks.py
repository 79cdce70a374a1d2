"""Language identification against a plain version, text by text, in blocks of languages, and with cut texts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as li

WORDS = {
    "en": "the cat and dog with their house this that water", "de": "der hund und katze mit ihrem haus dies wasser", "fr": "le chien et chat avec leur maison cette eau",
    "es": "el perro y gato con su casa esta agua", "it": "il cane e gatto con la loro casa questa acqua", "nl": "de hond en kat met hun huis dit water", "eo": "la hundo kaj kato kun ilia domo",
}


def corpus(n=40):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS[k].split(), 8)) + ".", k) for i, k in enumerate(sorted(WORDS) * n)]
    return [*rows, (None, "the cat", "en"), (9001, None, "en"), (9002, "", "de"), (9003, "123 !", None), (9004, "x", None), (9004, "x", None), (9005, "The CAT́ İs " * 700, None)]


def plain_grams(text):
    c = "".join(chr(int(li.letters()[ord(x)])) for x in f" {text} ")
    for n in li.ORDERS:
        for i in range(len(c) - n + 1):
            if c[i] != " " or c[i + n - 1] != " ":
                yield n, c[i : i + n]


def plain(rows, train):
    counts = defaultdict(Counter)
    for _, t, k in train:
        counts[k].update(plain_grams(t))
    out = {}
    for i, t, _ in rows:
        got = Counter(plain_grams(t or ""))
        if not any(ch.isalpha() for ch in t or ""):
            out[i] = ("und", 0.0)
            continue
        s = {k: sum(m * math.log((c[g] + li.SMOOTHING) / (sum(c.values()) + li.SMOOTHING * li.BUCKETS)) for g, m in got.items()) for k, c in counts.items()}
        best = max(s, key=lambda k: (s[k], k))
        out[i] = (best, 1 / sum(math.exp(v - s[best]) for v in s.values()))
    return out


@pytest.mark.parametrize(("block", "size"), [(100, 1 << 19), (3, 1 << 19), (2, 50)])
def test_equals_a_plain_version(spark, monkeypatch, block, size):
    """All languages are learned, whatever the block; hash collisions move scores a little."""
    monkeypatch.setattr(li, "PIECE_CHARS", size)
    monkeypatch.setattr(li, "GATHERED", size * block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("own")).withColumn("_best", F.lit("own"))
    held = {r.doc_id: r.h for r in docs.select("doc_id", li.held_out().alias("h")).collect()}
    assert held[None] is False and {True, False} == set(held.values())
    model = li.fit(docs, block=block)
    assert model.languages == tuple(sorted(WORDS)) and len(model.blocks) == -(-len(WORDS) // block)
    want = plain(rows, [r for r in rows if r[0] is not None and r[1] is not None and r[2] and not held[r[0]]])
    got = li.identify(docs.drop("_best", "score"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 0.02, r


def test_a_text_alone_equals_it_in_a_batch():
    texts = ["x", "la casa", "", "Zug um Zug", "a" * 40]
    rng = np.random.default_rng(2)
    block = li.LanguageBlock(("p", "q", "r"), np.concatenate([rng.normal(size=(3, li.BUCKETS)), np.zeros((3, 1))], axis=1))
    together = block.sums(texts)[0]
    assert all(np.allclose(block.sums([t])[0][0], row) for t, row in zip(texts, together))
