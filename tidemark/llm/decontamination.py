"""Benchmark decontamination with DataFrame functions only: a broadcast hash set of item windows, scanned along every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

WINDOW_WORDS = 10
#: What words and the gaps between them are made of.
WORD, GAP = r"[0-9A-Za-z\x80-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Bytes of windows that are sent to every task at once; more of them are scanned for in blocks, one pass each.
BLOCK_BYTES = 32 << 20
#: Rows of (text, spans) or of (set, item) that are sent to every task; more are joined by a shuffle.
SMALL_ROWS = 100_000


def _lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; `lower` is quicker and the same where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column) -> Column:
    """The words of a text in order; none for a null one."""
    return F.regexp_extract_all(_lower(F.coalesce(text, F.lit(""))), F.lit(f"{WORD}+"), F.lit(0))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _sent(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, a written table, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different windows (window, length, set_id), and the items of each set (set_id, item).

    Windows of the same items share a set, so a passage that many items hold
    is one set however many windows it has. Windows are counted and grouped
    before they meet, and an item without an id has windows but no row in its set.
    """
    own = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.size("w") - WINDOW_WORDS)
    each = own.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, WINDOW_WORDS))).alias("w"))
    each = each.select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("length")).distinct()
    grouped = cut(each.groupBy("window", "length").agg(F.array_sort(F.collect_list("item")).alias("held")).withColumn("set_id", F.sha2(F.to_json("held"), 256)))
    sets = grouped.select("set_id", "held").dropDuplicates(["set_id"]).select("set_id", F.explode("held").alias("item"))
    return grouped.select("window", "length", "set_id"), cut(sets)


def window_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Where windows occur: (digest, pos, length, set_id), once per different text.

    Each place of a text is looked up by the hash of its words in the set
    that every task holds, and the words themselves are compared on a match;
    all of it is one stage of generated code, so nothing is copied per place.
    Rows of copies fall together before they are shuffled.
    """
    known = windows.agg(F.sum(F.length("window") + 64).alias("bytes"), F.collect_set("length").alias("lengths")).first()
    blocks = (known.bytes or 0) // BLOCK_BYTES + 1
    texts = docs.where(F.col("text").isNotNull()).select(_digest(F.col("text")).alias("digest"), words(F.col("text")).alias("w"))
    places = texts.select("digest", "w", F.posexplode_outer("w").alias("pos", "word"))
    out = None
    for block in range(blocks):
        for length in sorted(known.lengths):
            keys = windows.where((F.col("length") == length) & (F.pmod(F.xxhash64("window"), F.lit(blocks)) == block))
            keys = keys.select(F.xxhash64(F.split("window", " ")).alias("h"), "window", "set_id")
            here = F.slice("w", F.col("pos") + 1, length)
            seen = places.where(F.col("pos") + length <= F.size("w")).select("digest", "pos", F.xxhash64(here).alias("at_h"), here.alias("here"))
            same = F.array_join("here", " ")  # between, as an equality would be a second key and be built for every place
            found = seen.join(F.broadcast(keys), (F.col("at_h") == F.col("h")) & F.col("window").between(same, same))
            found = found.select("digest", "pos", F.lit(length).alias("length"), "set_id")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "digest binary, pos int, length int, set_id string")
    return out.distinct()


def contaminated_texts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per different text in which a window occurs: digest, n_hit, spans (array of first, end in words), n_items, items_sha256. A written table."""
    windows, sets = item_windows(items)
    hits = cut(window_hits(docs, windows))
    by_text = Window.partitionBy("digest").orderBy("pos")
    ends = hits.groupBy("digest", "pos").agg(F.max(F.col("pos") + F.col("length")).alias("end"))
    before = F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    islands = ends.withColumn("new", F.coalesce(before < F.col("pos"), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(by_text))
    spans = islands.groupBy("digest", "island").agg(F.min("pos").alias("first"), F.max("end").alias("end"))
    spans = spans.groupBy("digest").agg(F.sum(F.col("end") - F.col("first")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))
    held = hits.select("digest", "set_id").distinct().join(_sent(sets), "set_id").groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("held"))
    ids = F.coalesce("held", F.array().cast("array<string>"))
    return cut(spans.join(held, "digest", "left").select("digest", "n_hit", "spans", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256")))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words. Equal texts, also in repeated rows, get equal
    values. An item without words has no window; one without an id marks words
    and is not counted. Empty tables give no rows, or no hits. Other columns
    are not read. A task holds the words of one text at a time.
    """
    found = _sent(contaminated_texts(docs, items).drop("spans"))
    own = docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"{WORD}+")).cast("long").alias("n_words"), _digest(F.col("text")).alias("digest"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.join(found, "digest", "left").select("doc_id", "n_words", n("n_hit"), n("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def _marked(docs: DataFrame, items: DataFrame, *names: str) -> DataFrame:
    found = contaminated_texts(docs, items).select(F.col("digest").alias("_digest"), *(F.col(c).alias(f"_{c}") for c in names))
    return docs.withColumn("_digest", _digest(F.col("text"))).join(_sent(found), "_digest", "left").drop("_digest")


def drop_documents(docs: DataFrame, items: DataFrame, most_hit: int = 0) -> DataFrame:
    """docs without those of which more than most_hit words are hit; all columns stay as they are."""
    return _marked(docs, items, "n_hit").where(F.coalesce("_n_hit", F.lit(0)) <= most_hit).drop("_n_hit")


def remove_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs whose texts lack the words that are hit, each with the characters between it and the word before; all else stays as it is."""
    marked = _marked(docs, items, "spans")
    pieces = F.regexp_extract_all("text", F.lit(f"{GAP}*{WORD}+"), F.lit(0))
    tail = F.regexp_extract("text", rf"({GAP}*)\z", 1)
    n = F.size(pieces)
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("_spans", lambda s: F.array(s["first"], s["end"]))), F.array(n))
    between = F.transform(F.sequence(F.lit(0), F.size("_spans")), lambda k: F.slice(pieces, F.get(edges, 2 * k) + 1, F.get(edges, 2 * k + 1) - F.get(edges, 2 * k)))
    return marked.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.flatten(between), ""), tail))).drop("_spans")
