"""From raw documents to training sequences: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, language_id, packing, quality
from tidemark.llm.base import cut
from tidemark.llm.queries import table, tokenizer

#: A document whose language is less certain than this is rejected.
LEAST_CERTAINTY = 0.9


def carried(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], list]:
    """docs with all columns but doc_id and text under reserved names, so that none clashes with an operator's; the columns to carry; and how they get their names back."""
    own = {c: c if c in ("doc_id", "text") else f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), tuple(own.values()), [F.col(name).alias(c) for c, name in own.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose language is in doubt."""
    model = language_id.fit(docs)
    rows, names, back = carried(docs)
    return language_id.identify(rows, model, names).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CERTAINTY)).select(*back)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose predicted quality is 0."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows, names, back = carried(docs)
    return quality.score_documents(rows, model, names).where("predicted = 1").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of documents whose shingle sets are linked."""
    return jaccard_join.first_of_groups(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: No stage but the near-duplicate join can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage applied in turn to `documents`; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
