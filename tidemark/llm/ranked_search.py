"""Ranked lexical search without random access (NRA): impact-sorted lists are read downwards until the best documents and their scores are certain."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, small_batches

#: Fixed values of the score: parts of 1000 that do not and do depend on the length of a document, the scale of tf and of an impact, the weight of the length.
FLAT, SLOPE, TF_SCALE, IMPACT_SCALE, LENGTH_WEIGHT = 10, 90, 1000, 1_000_000_000, 8
#: Documents and postings that a task searches at once; their lists and score intervals are all that it holds.
SHARD_DOCS, SHARD_POSTINGS = 50_000, 4_000_000
#: Different terms of the items that are searched for in one pass over the documents; further items make further passes.
BLOCK_TERMS = 200_000
#: Marks that a document has been seen in a list, for all lists of an item and a shard.
MOST_MARKS = 64_000_000
#: A step reads every list down to the impact that the last step's was multiplied by.
STEP = 0.7

#: Each byte of UTF-8 as it counts in a term: letters in lower case, other word bytes as they are, a space for all else.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in order. All bytes of a character beyond ASCII are 128 or more, so they can be told by bytes."""
    return (text or b"").translate(_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """A row per document: doc_id, n (its terms with repeats), and the known terms in it with their counts (term_ids, tfs). A written table."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at, found, counts = [], [0], [], []
            for text in batch.column(1):
                own = terms(text.as_py())
                n.append(len(own))
                got = Counter(filter(known.__contains__, own))
                found.extend(map(known.__getitem__, got))
                counts.extend(got.values())
                at.append(len(found))
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(found, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))],
                names=["doc_id", "n", "term_ids", "tfs"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, n long, term_ids array<int>, tfs array<long>"))


def impacts(tf: np.ndarray, w: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting adds to a score: w * (10^9 tf div (1000 tf + 8 m))."""
    return w * (IMPACT_SCALE * tf // (TF_SCALE * tf + LENGTH_WEIGHT * m))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of n_docs documents, and their scores, from lists of (documents, impacts), each by falling impact.

    `order` says how documents of one score follow each other. Every step
    reads all lists on to a lower impact. `low` is what has been read of a
    document; its upper bound adds, for each list that it has not been seen
    in, the impact that the list goes on with. Once a document not seen at
    all cannot reach the k-th best lower bound, only documents that can are
    kept. The search ends when no kept document's bounds differ, so that
    membership, ties and scores are final. A score of 0 is no hit.
    """
    low, seen = np.zeros(n_docs, np.int64), np.zeros((len(lists), n_docs), bool)
    at, ahead = np.zeros(len(lists), np.int64), np.array([x[0] if len(x) else 0 for _, x in lists], np.int64)
    kept = None  # documents that can still be among the best, once that is known
    level = int(ahead.max(initial=0))
    while ahead.any():
        level = int(level * STEP)
        for i, (docs, worth) in enumerate(lists):
            if ahead[i] > level:  # the list goes on above the level of this step
                end = len(worth) - int(np.searchsorted(worth[::-1], level, "right"))
                read = docs[at[i] : end]
                low[read] += worth[at[i] : end]
                seen[i, read] = True
                at[i], ahead[i] = end, worth[end] if end < len(worth) else 0
        there = low if kept is None else low[kept]
        bar = int(np.partition(there, -k)[-k]) if len(there) >= k else 0
        if kept is None:
            if ahead.sum() >= bar:  # a document not seen at all may still come in, or tie
                continue
            kept = np.flatnonzero(low)
        open_lists = np.flatnonzero(ahead)
        missing = np.zeros(len(kept), np.int64)
        for i in open_lists:
            missing += np.where(seen[i, kept], 0, ahead[i])
        able = low[kept] + missing >= bar
        kept, missing = kept[able], missing[able]
        if not missing.any():
            break
    kept = np.flatnonzero(low) if kept is None else kept[low[kept] > 0]
    best = np.lexsort((order[kept], -low[kept]))[:k]
    return kept[best], low[kept[best]]


def _search_shard(ids: pa.Array, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> pa.RecordBatch:
    m = FLAT + (SLOPE * n * n_docs) // max(1, n_terms)
    worth = impacts(tf, weights[term], m[doc])
    by = np.lexsort((-worth, term))
    term, doc, worth = term[by], doc[by], worth[by]
    starts = np.searchsorted(term, np.arange(len(weights) + 1))
    order = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    out_item, out_doc, out_score = [], [], []
    for q, own in enumerate(items):
        lists = [(doc[a:b], worth[a:b]) for a, b in zip(starts[own], starts[own + 1], strict=True)]
        best, scores = nra([x for x in lists if len(x[0])], len(n), k, order)
        out_item += [q] * len(best)
        out_doc.append(best)
        out_score.append(scores)
    docs = pa.array(np.concatenate(out_doc) if out_doc else [], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(out_item, pa.int32()), ids.take(docs), pa.array(np.concatenate(out_score) if out_score else [], pa.int64())], names=["item", "doc_id", "score"])


def _search(docs: DataFrame, items: list[list[bytes]], k: int) -> DataFrame:
    """(item, doc_id, score): for each item, by its place in the block, the k best of every shard of docs."""
    known = {t: i for i, t in enumerate(sorted(set().union(*items)))}
    index = postings(docs, known)
    whole = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    df = dict(index.select(F.explode("term_ids").alias("t")).groupBy("t").count().collect())  # one row a known term
    weights = np.array([weight(whole.docs, df.get(i, 0)) for i in range(len(known))], np.int64)
    own = [np.array([known[t] for t in x], np.int64) for x in items]
    n_docs, n_terms = whole.docs, whole.terms or 0
    most_docs = max(1, min(SHARD_DOCS, MOST_MARKS // max(map(len, own))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], [0, 0]

        def search() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists, counts = t["term_ids"].combine_chunks(), t["tfs"].combine_chunks()
            ids, n = t["doc_id"].combine_chunks(), t["n"].to_numpy()
            doc = pc.list_parent_indices(lists).to_numpy()
            return _search_shard(ids, n, doc, lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy(), own, weights, n_docs, n_terms, k)

        for batch in batches:
            more = pc.sum(pc.list_value_length(batch.column(2))).as_py() or 0
            if held and (size[0] + batch.num_rows > most_docs or size[1] + more > SHARD_POSTINGS):
                yield search()
                held, size = [], [0, 0]
            held.append(batch)
            size = [size[0] + batch.num_rows, size[1] + more]
        if size[0]:
            yield search()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return index.mapInArrow(run, f"item int, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item by lexical score: item_id, rank from 1, doc_id, score.

    Statistics (documents with terms, terms, documents that hold a term) are
    of all rows of docs. Every shard of documents is searched for every item,
    and the best of the shards are merged, so nothing is shuffled but k rows
    an item and task. Repeated rows of docs are documents of their own;
    repeated rows of items are searched for once. A null text has no terms, a null or
    empty item no result, a document without an item's terms no score; a null
    doc_id comes before others of its score. Other columns are not read.
    """
    blocks, own, size = [], [], 0
    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).distinct().toLocalIterator():
        x = sorted(set(terms(row.text)))
        if own and size + len(x) > BLOCK_TERMS:
            blocks.append(own)
            own, size = [], 0
        if x:
            own.append((row.item_id, x))
            size += len(x)
    blocks.append(own)
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    out = None
    for block in blocks:
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {kind}")
        found = _search(docs, [x for _, x in block], k) if block else spark.createDataFrame([], f"item int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
