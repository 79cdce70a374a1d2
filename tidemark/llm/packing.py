"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, map_batches, texts_of
from .bpe import byte_characters

CAPACITY = 2048
END_ID = 0
#: The fixed pattern of byte-level BPE: a word takes the space before it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A bin with at most so much room is emitted at once.
NEARLY_FULL = 8
#: Pieces that one task packs in a later round.
GROUP_PIECES = 40_000


class ByteEncoder:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file.

    Ids in such a file follow the merge order, so its vocabulary serves as ranks
    for tiktoken, which encodes several times as fast. Texts with a very long
    stretch without spaces go to the tokenizers library itself.
    """

    LONG_STRETCH = 5000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte = {c: i for i, c in enumerate(byte_characters())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if len(text) > self.LONG_STRETCH and max(map(len, text.split(" "))) > self.LONG_STRETCH:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: its ids and then END_ID, cut only if they exceed capacity.

    A longer document's first piece takes the remainder, all others are full.
    A null text is an empty one, which is a piece of END_ID alone. Repeated rows
    and null ids stay as rows of their own.
    """

    def cut_up(batch: dict) -> Iterator[dict]:
        enc = encoder(tokenizer)
        doc, piece, start, length, crc = [], [], [], [], []
        for i, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"])):
            ids = np.append(enc.encode(text), np.uint32(END_ID)).astype("<u4")
            edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                doc.append(i)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(ids[a:b].tobytes()))
        yield {"doc_id": doc, "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    return map_batches(docs.select("doc_id", "text"), cut_up, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, items taken from large to small, each to the fullest bin with room (bins from 0)."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0  # mask: bit r is set if a bin has room r
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        above = mask >> size
        if above:
            room = size + ((above & -above).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        if left := room - size:
            by_room[left].append(b)
            mask |= 1 << left
    return out


STATE = "bin bigint, first boolean, done boolean, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pack_task(level: int, capacity: int, final: bool):
    """Best fit of all bins in the task, each an item of its pieces' total length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        t = t.sort_by([("bin", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = t["length"].to_numpy()
        if level:
            _, item = np.unique(t["bin"].to_numpy(), return_inverse=True)
        else:
            item = np.arange(len(length))
        sizes = np.bincount(item, weights=length).astype(np.int64)
        packed = best_fit(sizes, capacity)
        fill = np.bincount(packed, weights=sizes).astype(np.int64)
        # a bin without room for the smallest item of the task may still find a smaller one elsewhere, so it stays
        done = np.full(len(fill), True) if final else capacity - fill <= NEARLY_FULL
        base = (level << 44) + (TaskContext.get().partitionId() << 24)  # room for a million tasks of 16 million bins
        of = packed[item]
        first = np.zeros(len(of), bool)
        first[np.unique(of, return_index=True)[1]] = True
        t = t.set_column(t.schema.get_field_index("bin"), "bin", pa.array(of + base, pa.int64()))
        t = t.set_column(t.schema.get_field_index("first"), "first", pa.array(first, pa.bool_()))
        t = t.set_column(t.schema.get_field_index("done"), "done", pa.array(done[of], pa.bool_()))
        yield from t.to_batches(max_chunksize=10_000)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset: every sequence holds at most capacity tokens, without gaps.

    Each partition packs its own pieces by best fit, from large to small; bins
    with at most NEARLY_FULL tokens of room are emitted, and the others go as
    items to the next round, where each task takes those of several partitions.
    Rounds go on until one task holds all that is left, or a round joins nothing:
    bins are counted exactly, and each round deals them out anew. Tasks are of about
    GROUP_PIECES pieces however large the input. Null ids and repeated rows are
    pieces like others; an empty table gives none.
    """
    spark = pieces.sparkSession
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    state = pieces.select(F.lit(0).cast("bigint").alias("bin"), F.lit(False).alias("first"), F.lit(False).alias("done"), *cols)
    emitted, level, groups, bins_before = [], 0, None, None
    while True:
        final = level > 0 and groups == 1
        state = cut(state.mapInArrow(_pack_task(level, capacity, final), STATE))
        emitted.append(state.where("done"))
        rest = state.where("not done")
        if final:
            break
        n, bins = rest.agg(F.count(F.lit(1)), F.count_if("first")).first()
        if not n:
            break
        groups = -(-n // GROUP_PIECES)
        if groups > 1 and bins == bins_before:
            emitted.append(rest)
            break
        bins_before = bins
        level += 1
        state = rest.repartition(groups, F.xxhash64("bin", F.lit(level)) if groups > 1 else F.lit(0))
    out = emitted[0]
    for x in emitted[1:]:
        out = out.union(x)
    # a bin has at most `capacity` pieces, so this window's groups are small
    from pyspark.sql import Window

    before = Window.partitionBy("bin").orderBy("doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return out.select(*cols, F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut(tokenised_pieces(docs, tokenizer, capacity)), capacity)
