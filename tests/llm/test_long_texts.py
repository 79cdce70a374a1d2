"""Very long texts in parts, ids that repeat or are null, and plain versions of the quality scan and the tag-path ratios."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import base, features, fingerprints, html_text, jaccard_join, language_id, quality, sharding

WORDS = "alpha Beta GAMMA delta, epsilon. 12 x9 !! don't naïve Ünder 漢字 a".split()


def texts(seed=3):
    rng = random.Random(seed)
    out = [rng.choice(["", " ", "\n"]).join([" ".join(rng.choices(WORDS, k=rng.randint(0, 60))), " ".join(rng.choices(WORDS, k=5))]) for _ in range(30)]
    return [*out, "", " \t", "w" * 100, "w" * 64, f"a {'b' * 200} c d e f g", "one two three four five " * 40]


@pytest.mark.parametrize("size", [16, 64, 100])
def test_shingles_do_not_depend_on_the_parts(monkeypatch, size):
    want = [s.tolist() for s in base.shingles(texts())]
    monkeypatch.setattr(base, "CHUNK_CHARS", size)
    monkeypatch.setattr(base, "_powers", {})
    assert [s.tolist() for s in base.shingles(texts())] == want
    assert (fingerprints.signatures(texts()[:5]) == fingerprints.signatures(texts())[:5]).all()


def test_features_of_a_text_in_parts_and_against_loops(monkeypatch):
    some = [t for t in texts() if all(len(w) < 40 for w in t.split())]
    whole = features.text_features(some)
    for t, row in zip(some, whole):
        w = t.split()
        got = dict(zip(features.NAMES, row))
        if not w:
            assert not row.any()
            continue
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in w]
        assert got["digit"] == pytest.approx(sum(c.isdigit() for c in t) / len(t)) and got["upper"] == pytest.approx(sum(c.isupper() for c in t) / len(t))
        assert got["newline"] == pytest.approx(t.count("\n") / len(t)) and got["word_length"] == pytest.approx(min(np.mean([len(x) for x in w]) / 20, 1))
        assert got["short_words"] == pytest.approx(np.mean([len(x) < 3 for x in w])) and got["new_words"] == pytest.approx(len(set(low)) / len(w))
        assert got["same_word"] == pytest.approx(sum(a == b for a, b in zip(low, low[1:])) / len(w))
        pairs = list(zip(low, low[1:]))
        assert got["same_shingle"] == pytest.approx((len(pairs) - len(set(pairs))) / len(w), abs=1e-9)
    for m in (base, features):
        monkeypatch.setattr(m, "CHUNK_CHARS", 64)
    assert np.abs(features.text_features(some) - whole).max() < 1e-9


def test_operators_on_a_text_of_a_million_words(spark):
    long = "Many words make, as they go on, a rather long text. " * 100_000
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, long[:-1], "en", "s"), (3, "short", "en", "t")], "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
    got = {r.doc_id: r for r in fingerprints.edit_likeness(docs).collect()}
    assert got[1].n_chars == len(long) and got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(docs)).collect()} == {"en"}
    assert quality.score_documents(docs, quality.fit_pairs(np.zeros((0, len(features.NAMES))), np.zeros(0, int))).count() == 3
    assert {r.doc_id: r["size"] for r in sharding.interleave(docs, 2).collect()}[1] == len(long) + 16


def test_next_documents_of_repeated_and_null_ids(spark):
    rows = [(i, f"t{i} one two three four five six") for i in range(40)] + [(7, "again seven"), (7, "again seven"), *((None, f"none {i}") for i in range(50))]
    got = fingerprints.with_next_text(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert sorted(r.next_text for r in got) == sorted(t for _, t in rows)  # every row is next to one other
    by = {r.doc_id: r for r in got}
    assert all(by[i].next_text == f"t{i - 1} one two three four five six" for i in range(1, 40) if i not in (7, 8))
    edited = {r.doc_id: r.edited_sha256 for r in fingerprints.edit_likeness(spark.createDataFrame(rows[:5], "doc_id bigint, text string")).collect()}
    t, n = rows[3][1], rows[2][1]
    assert edited[3] == hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()


def plain_paths(nodes):
    """The ratios of content_paths, path by path."""
    own, keys = {}, []
    for x in nodes:
        k, text = (x.path, x.classed, x.main), x.text.strip()
        if text and not x.apart:
            if k not in own:
                own[k] = []
                keys.append(k)
            own[k].append((text, x.block, x.link))
    if not keys:
        return set()
    length = {k: sum(len(t) for t, _, _ in own[k]) for k in keys}
    marks = {k: sum(len(html_text.PUNCTUATION.findall(t)) for t, _, _ in own[k]) for k in keys}
    count = {k: len({b for _, b, _ in own[k]}) for k in keys}
    links = {k: sum(len(t) for t, _, is_link in own[k] if is_link) for k in keys}
    weight = {k: html_text.CLASS_WEIGHT if k[1] else 1.0 for k in keys}
    kind = lambda k: (k[1], k[2] > 0)
    of = lambda k: [j for j in keys if j[2] == k[2]]
    share_of_links = {k: sum(links[j] for j in of(k)) / sum(length[j] for j in of(k)) for k in keys}
    plain = {k: 1 - links[k] / length[k] * min(1, share_of_links[k] / html_text.LINK_SHARE) for k in keys}

    def smooth(v, k):
        row = [j for j in keys if kind(j) == kind(k)]
        i = row.index(k)
        return 0.25 * v[row[max(i - 1, 0)]] + 0.5 * v[k] + 0.25 * v[row[min(i + 1, len(row) - 1)]]

    long, dense = {k: length[k] / count[k] for k in keys}, {k: 1 + marks[k] / count[k] for k in keys}
    fused = {k: (0.5 * long[k] * dense[k] + 0.5 * smooth(long, k) * smooth(dense, k)) * weight[k] for k in keys}
    if max(fused[k] * plain[k] for k in keys) <= 0:
        return set()
    worth = {k: length[k] * (0.25 + 0.75 * min(1, marks[k] * html_text.SENTENCE / length[k])) * plain[k] * weight[k] for k in keys}
    evidence = {k: sum(worth[j] for j in of(k)) for k in keys}
    marked = max([evidence[k] for k in keys if k[2]], default=0)
    sides = {True: marked * html_text.MARK_WEIGHT, False: max([evidence[k] for k in keys if not k[2]], default=0)}
    side = {k: (sides[k[2] > 0] / max(sides.values())) ** html_text.SIDE_POWER for k in keys}
    top = {m: max([fused[k] * plain[k] for k in keys if (k[2] > 0) == m], default=0) for m in (True, False)}
    ratio = {k: min(fused[k] / top[k[2] > 0], 1) * plain[k] if top[k[2] > 0] > 0 else 0.0 for k in keys}
    score = {}
    for k in keys:
        power = max((1 - min(evidence[k] / (marked or 1), 1)) ** 2, html_text.LEAST_POWER) if k[2] and not k[1] else 1
        score[k] = ratio[k] ** power * side[k]
    some = [ratio[k] for k in keys if ratio[k] > 0 and side[k] == 1]
    least = max(float(np.std(some)), html_text.LEAST_SCORE)
    if max(score.values()) < least:
        return {k for k in keys if score[k] == max(score.values()) > 0}
    return {k for k in keys if score[k] >= least - 1e-12}


def test_ratios_against_loops():
    rng = random.Random(8)
    differ = 0
    for _ in range(200):
        nodes = [html_text.Node(p := rng.randrange(6), 10 * p + rng.randrange(3), " ".join(rng.choices(WORDS, k=rng.choice([1, 3, 30]))), rng.random() < 0.1, rng.choice([0, 0, 1, 2]), rng.random() < 0.2, 0, rng.random() < 0.2) for _ in range(rng.randint(0, 25))]
        got = html_text.content_paths(nodes)
        assert got == plain_paths(nodes)
        differ += got != {(x.path, x.classed, x.main) for x in nodes if x.main and not x.apart}
    assert differ > 100  # not simply what is marked


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "text", "<div>" * 50_000 + "</section>" * 50_000 + "text", "<div><p>" * 30_000 + "text" + "</p></div>" * 30_000])
def test_deep_pages_stay_linear(page):
    assert html_text.main_text(page) == "text"


def test_batches_of_many_long_texts_are_bounded_in_bytes(spark):
    """300 texts of a megabyte fall within the bound on rows; the bytes of a batch are bounded as well."""
    docs = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("long "), 200_000).alias("text"))

    def size(batch):
        yield {"rows": [len(batch["text"])], "bytes": [batch["text"].nbytes]}

    got = base.map_batches(docs.select("text"), size, "rows bigint, bytes bigint").collect()
    assert sum(r["rows"] for r in got) == 300 and max(r["bytes"] for r in got) < 80 << 20 and len(got) >= 4
