"""Stages of the pipeline on documents whose own columns have the names of an operator's."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_filter_stages_carry_clashing_columns(spark):
    plain = table(spark, SF, "documents")
    extra = plain.withColumns({"score": F.concat(F.lit("s"), "doc_id"), "predicted": -F.col("doc_id"), "lang_pred": F.lit("own"), "label": F.lit(None).cast("double"), "a.b": F.array("doc_id"), "_own_0": F.lit(7)})
    for _, stage in cp.STAGES[:2]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns and out.dtypes == extra.dtypes
        got, want = out.collect(), {r.doc_id for r in stage(spark, plain, SF).collect()}
        assert len(got) == len(want) > 0 and {r.doc_id for r in got} == want
        assert all(r["score"] == f"s{r.doc_id}" and r["predicted"] == -r.doc_id and r["lang_pred"] == "own" and r["label"] is None and r["a.b"] == [r.doc_id] and r["_own_0"] == 7 for r in got)


def test_other_stages_carry_clashing_columns(spark):
    docs = table(spark, SF, "documents").limit(60).withColumns({c: F.lit("own") for c in ("score", "predicted", "lang_pred", "component_id", "sequence_id", "piece", "offset", "size", "key")})
    out = cp.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns and out.where("score = 'own' and predicted = 'own' and component_id = 'own'").count() == out.count() > 0
    assert {r.doc_id for r in cp.pack_sequences(spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()}
