"""Pairs of sets around a common lead, found by what tells them from it.

Near copies of one text share nearly all that a signature can hold, so among
them shared keys say little. What each differs in from a lead (`difference`,
its symmetric difference to the lead's set) says more. Let sets of a and b
elements link if they differ in at most c * (a + b), c being
(100 - percent) / (100 + percent), and let a differ from its lead in more than
that. If a and b link, their differences have more than
(|Db| + c * (|lead| - |b|)) / 2 elements in common, and at least
(|Da| - c * (|a| + |lead|)) / (1 + c). With elements in one order, rarest first, the
first common one then lies within the first |D| + 1 less that number of either
difference. Few pairs share such an element, as rare ones come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, hot_keys, join_hot, map_batches, only, shingles, signed, small_batches, texts_of

#: Members whose sets are compared with their leads' at once.
MEMBER_BATCH = 50
#: Rows of a batch of differences.
ELEMENT_BATCH = 50_000


def differences(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(lead, doc_id, x, d, size, lead_size): each element x of the d in which a member (lead, doc_id) differs from its lead.

    A task holds MEMBER_BATCH pairs of sets at a time.
    """
    ids = members.select("doc_id").union(members.select(F.col("lead").alias("doc_id"))).distinct()

    def sets(batch: dict) -> Iterator[dict]:
        yield {"doc_id": batch["doc_id"], "elements": [signed(np.unique(s)) for s in shingles(texts_of(batch["text"]))]}

    known = cut(map_batches(only(docs.select("doc_id", "text"), ids, "doc_id"), sets, "doc_id bigint, elements array<bigint>"))
    both = join_hot(members.select("lead", "doc_id"), known.toDF("lead", "theirs"), "lead", "doc_id", hot_keys(members, "lead")).join(known.toDF("doc_id", "own"), "doc_id")

    def differ(batch: dict) -> Iterator[dict]:
        lead, doc, own, theirs = batch["lead"].to_numpy(), batch["doc_id"].to_numpy(), batch["own"], batch["theirs"]
        found, sizes = [], []
        for i in range(len(doc)):
            a, b = own[i].values.to_numpy(), theirs[i].values.to_numpy()
            found.append(np.setxor1d(a, b, assume_unique=True))
            sizes.append((len(found[-1]), len(a), len(b)))
        d = np.array(sizes, np.int64)
        x = np.concatenate(found)
        rows = {"lead": np.repeat(lead, d[:, 0]), "doc_id": np.repeat(doc, d[:, 0]), "x": x} | {c: np.repeat(d[:, k], d[:, 0]) for k, c in enumerate(("d", "size", "lead_size"))}
        for at in range(0, len(x), ELEMENT_BATCH):
            yield {c: v[at : at + ELEMENT_BATCH] for c, v in rows.items()}

    out = map_batches(both.select("lead", "doc_id", "own", "theirs"), differ, "lead bigint, doc_id bigint, x bigint, d bigint, size bigint, lead_size bigint")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(MEMBER_BATCH))
    out = cut(out)
    small_batches(docs.sparkSession)
    return out


def pairs_around_leads(members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: of the members (lead, doc_id, component) of each lead, pairs of different components that may link, leads included.

    Every linked pair of members of one lead is among them, unless it has one
    component. Members that link with their lead have its component, so one of a
    pair is a straggler, which does not.
    """
    members = cut(members.select("lead", "doc_id", "component").distinct())
    with_lead = members.where("doc_id != lead").select("lead", "doc_id", "component").join(members.where("doc_id = lead").select("lead", F.col("component").alias("lead_component")), "lead", "left")
    with_lead = with_lead.where("lead_component is null or component != lead_component").select(F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b"))
    rows = differences(members.where("doc_id != lead"), docs)
    much, less = F.lit(100 + percent), F.lit(100 - percent)
    size, lead_size, d = F.col("size"), F.col("lead_size"), F.col("d")
    straggler = much * d > less * (size + lead_size)
    of_any = F.floor((much * d + less * (lead_size - size)) / (2 * much)) + 1
    of_straggler = F.greatest(F.lit(1), F.ceil((much * d - less * (size + lead_size)) / 200))
    often = rows.groupBy("lead", "x").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lead", "doc_id").orderBy("n", "x"))  # as many rows as the two sets have at most
    early = rows.join(often, ["lead", "x"]).withColumn("place", place).where("n > 1")
    early = early.select("lead", "x", "doc_id", "size", straggler.alias("straggler"), (F.col("place") <= d - of_any + 1).alias("near"), (F.col("place") <= d - of_straggler + 1).alias("far"))
    early = cut(early.where("near or (straggler and far)").join(members, ["lead", "doc_id"]))
    x, y = early.where("straggler").alias("x"), early.where("near").alias("y")
    met = F.expr("x.component != y.component and (x.near and x.doc_id < y.doc_id or not y.straggler and x.far)") & (F.least("x.size", "y.size") * 100 >= F.greatest("x.size", "y.size") * percent)
    found = x.join(y, (F.col("x.lead") == F.col("y.lead")) & (F.col("x.x") == F.col("y.x")) & met)
    return with_lead.union(found.select(F.least("x.doc_id", "y.doc_id"), F.greatest("x.doc_id", "y.doc_id"))).distinct()
