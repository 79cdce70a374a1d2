"""Proportional stratified interleaving into shards, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

#: Ranks are counted in side x side cells for each source, and along the interleaved order, so that a cell has about so many rows; side is LEAST_SIDE or more.
ROWS_PER_CELL, LEAST_SIDE = 20_000, 128


def _before(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """Adds `start`, the rows in earlier cells (hi, lo) of the same `by`; the windows are over one side of the cells each."""
    outer = df.groupBy(*by, "hi").agg(F.sum(n).alias("hi_n"))
    w = Window.partitionBy(*by).orderBy("hi") if by else Window.orderBy("hi")
    outer = outer.withColumn("hi_start", F.sum("hi_n").over(w) - F.col("hi_n")).withColumn("whole", F.sum("hi_n").over(Window.partitionBy(*by)))
    inner = df.withColumn("lo_start", F.sum(n).over(Window.partitionBy(*by, "hi").orderBy("lo")) - F.col(n))
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, "hi"]]
    on = same[0]
    for c in same[1:]:
        on &= c
    return inner.alias("i").join(outer.alias("o"), on).select(*[f"i.{c}" for c in [*by, "hi", "lo"]], (F.col("lo_start") + F.col("hi_start")).alias("start"), "whole")


def _numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds `name`, the place of each row from 0 in (hi, lo, order) within `by`, and `whole`, the rows of `by`.

    Cells are counted first (counts combine before they shuffle), then rows are
    numbered within their cell, so that no task gets all rows of a hot group.
    """
    cells = cut(_before(cut(df.groupBy(*by, "hi", "lo").agg(F.count(F.lit(1)).alias("n"))), by, "n"))
    row = F.row_number().over(Window.partitionBy(*by, "hi", "lo").orderBy(*order))
    numbered = df.withColumn("row", row)
    on = F.lit(True)
    for c in [*by, "hi", "lo"]:
        on &= F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}"))
    return numbered.alias("d").join(cells.alias("c"), on).select("d.*", (F.col("c.start") + F.col("d.row") - 1).alias(name), "c.whole").drop("row")


def interleave(docs: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs (doc_id, text, source).

    Within each source, rows are shuffled by a seeded hash of the text, copies
    by one of their id, and ranked; all rows are then sorted by rank over size
    of the source, and cut into shards whose counts are at most one apart
    (`rows`), so that each has the mixture of sources. Copies of a text have
    nearly equal ranks in every source, so a group of them stays in few shards.
    A null text counts 16 bytes; null sources are a source of their own;
    repeated rows are rows of their own. grown_shard is null: a further shard
    moves rows between shards.
    """
    side = LEAST_SIDE
    n = docs.count()
    while side * side * ROWS_PER_CELL < n:
        side *= 2
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("source").isNull().alias("no_source"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit(seed)).alias("text_key"),
        F.xxhash64("doc_id", text, F.lit(seed)).alias("row_key"),
    )
    ranked = _numbered(
        keyed.withColumn("hi", F.pmod(F.shiftrightunsigned("text_key", 40), F.lit(side))).withColumn("lo", F.pmod(F.shiftrightunsigned("row_key", 40), F.lit(side))),
        ["source", "no_source"],
        [F.col("text_key"), F.col("row_key"), F.col("doc_id")],
        "rank",
    )
    ranked = cut(ranked.drop("hi", "lo", "text_key").withColumnRenamed("whole", "source_rows"))
    share = (F.col("rank") + 0.5) / F.col("source_rows")
    cell = F.least(F.floor(share * (side * side)), F.lit(side * side - 1))
    placed = _numbered(
        ranked.withColumn("share", share).withColumn("hi", F.floor(cell / side)).withColumn("lo", cell % side),
        [],
        [F.col("share"), F.col("source"), F.col("no_source"), F.col("row_key"), F.col("doc_id")],
        "place",
    )
    base, more = F.floor(F.col("whole") / shards), F.col("whole") % shards
    wide = more * (base + 1)
    shard = F.when(F.col("place") < wide, F.floor(F.col("place") / (base + 1))).otherwise(more + F.floor((F.col("place") - wide) / F.greatest(base, F.lit(1))))
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - F.col("shard") * base - F.least(F.col("shard"), more)).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
