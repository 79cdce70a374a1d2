"""Empty tables, repeated rows, nulls and columns with clashing names, for operators whose other tests leave them out."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, fingerprints, html_text, jaccard_join, language_id, packing, quality, sharding, url_filter
from tidemark.llm.queries import URL_RULES

ROWS = [(1, "Some words in here, and then some more.", "en", "s"), (1, "Some words in here, and then some more.", "en", "s"), (None, None, None, None), (2, "", None, "t"), (3, "12 !!", "en", None)]
CLASH = ("score", "predicted", "lang_pred", "held_out", "size", "shard", "slot", "law", "rank", "hi", "lo", "piece", "length", "bin", "done", "first", "fingerprint", "next_text", "r", "h", "ids", "n_tokens", "key", "component_id", "component", "lead", "band", "_text", "_best", "_top", "_all")


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").withColumns({c: F.array(F.lit(c)) for c in CLASH})


def operators(docs):
    byte, word = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return {
        "fingerprints": lambda d: fingerprints.edit_likeness(d), "quality": lambda d: quality.score_documents(d, quality.fit(d, labels)), "language": lambda d: language_id.identify(d, language_id.fit(d)),
        "jaccard": jaccard_join.similar_groups, "packing": lambda d: packing.pack_documents(d, byte), "bpe": lambda d: bpe.encode_documents(d, word), "sharding": lambda d: sharding.interleave(d, 40),
    }


def test_clashing_columns_repeated_rows_and_nulls(docs):
    for name, run in operators(docs).items():
        got = run(docs).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS), name


def test_empty_documents(docs):
    for name, run in operators(docs).items():
        out = run(docs.limit(0))
        assert out.count() == 0 and "doc_id" in out.columns, name


def test_quality_and_language_of_no_labels_and_null_ids(docs):
    scored = quality.score_documents(docs, quality.fit(docs, docs.select("doc_id", F.lit(None).cast("int").alias("quality"))))
    assert {r.score for r in scored.collect()} == {0.5}
    for held in (quality.held_out, language_id.held_out):
        assert docs.where(held().isNull()).count() == 0


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://x.net/es/1", "<article><p>One, two.</p></article>"), (1, "http://x.net/es/1", "<article><p>One, two.</p></article>"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "host", "path", "rule", "verdict", "branch", "template", "own", "n", "learned")})
    assert sorted(r.text for r in html_text.extract_pages(pages).collect()) == ["", "One, two.", "One, two."]
    assert sorted(r.verdict for r in url_filter.filter_urls(pages, URL_RULES).collect()) == ["allow", "block", "block"]
    assert html_text.extract_pages(pages.limit(0)).count() == url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0
