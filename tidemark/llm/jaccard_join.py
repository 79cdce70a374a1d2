"""Exact Jaccard self-join of documents on word shingles: universe partitions and the pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, hot_keys, join_hot, map_batches, mix, only, runs, shingles, signed, small_batches, texts_of
from .components import components
from .differences import pairs_around_leads

#: Similarity 4/5: sets of sizes r and s that link differ in at most r + s - 2 * ceil(4 (r + s) / 9) elements.
PERCENT = 80
#: A key of more documents than this is left out by those that others still lead to.
COMMON = 4
#: Segments beyond those that the pigeonhole principle needs, as a share of them.
SLACK = 0.2
#: Times that documents with too few shared keys are left out before pairs are sought in common keys.
KEY_ROUNDS = 2
#: Bits of a set's sketch.
SKETCH_BITS = 1024
#: Signatures of whole segments need about so many elements in each; otherwise fewer segments with deletions serve.
LEAST_ELEMENTS = 2.2


def most_differences(total: int) -> int:
    """Elements that linked sets with `total` elements together can differ in, at most."""
    return max((t - 2 * -(-4 * t // 9) for t in range(max(total - 9, 0), total + 1)), default=0)


@lru_cache
def band(k: int) -> tuple[int, int]:
    """Least size of band k and of the next one; bands grow by two fifths."""
    low = 4
    for _ in range(k):
        low = max(low + 1, low * 7 // 5)
    return low, max(low + 1, low * 7 // 5)


def band_of(size: int) -> int:
    k = 0
    while band(k)[1] <= size:
        k += 1
    return k


@lru_cache
def plan(k: int) -> tuple[int, bool, int]:
    """For pairs whose smaller set is in band k: segments, whether they allow a deletion, segments to spare.

    H differences cannot touch all of H + 1 segments, so one of them is equal;
    nor can they touch each of H // 2 + 1 segments twice, so one of them is equal
    but for one element. The cheaper of the two serves: whole segments make a
    signature each, deletions one for each element besides, but segments of
    very few elements agree by chance.
    """
    low, high = band(k)
    h = most_differences(high - 1 + (high - 1) * 5 // 4)
    spare = int(SLACK * (h + 1))
    m = h + 1 + spare
    if low / m >= LEAST_ELEMENTS:
        return m, False, spare
    return h // 2 + 1, True, 0


def bands_of(size: int) -> list[int]:
    """Bands in which a set of this size may be the smaller or the larger one of a pair."""
    if size < 4:
        return []
    own = band_of(size)
    out = [own]
    while out[-1] and 5 * (band(out[-1])[0] - 1) >= 4 * size:  # a smaller partner may be in the band before
        out.append(out[-1] - 1)
    return out


def segments(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each element of set s in band k, and the element's share of its segment's hash."""
    m = plan(k)[0]
    return (mix(s + np.uint64(k + 1)) % np.uint64(m)).astype(np.int64), mix(s)


def empties(s: np.ndarray, k: int) -> int:
    m = plan(k)[0]
    return m - len(np.unique(segments(s, k)[0]))


def signatures(s: np.ndarray, k: int) -> np.ndarray:
    """Keys of set s in band k; sets that link and meet in band k share one.

    An empty segment has a key only where deletions are allowed or the set has
    more empty ones than the band has to spare. A segment's hash is the sum of its
    elements' hashes, so leaving one out is a subtraction.
    """
    m, deletions, spare = plan(k)
    at, value = segments(s, k)
    sums, size = np.zeros(m, np.uint64), np.bincount(at, minlength=m)
    np.add.at(sums, at, value)
    tag = mix(np.arange(m, dtype=np.uint64) + np.uint64((k + 1) << 32))
    whole = mix(sums + tag)
    if deletions:
        return np.unique(np.concatenate([whole, mix(sums[at] - value + tag[at])]))
    return whole if (size == 0).sum() > spare else whole[size > 0]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements by SKETCH_BITS hash buckets. Two sets differ in at least as many elements as their sketches in bits."""
    odd = np.bincount((mix(s ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    return map(np.unique, shingles(texts))


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, a 128-bit hash and a sketch of each document's shingle set, and for each of its bands the number of empty segments."""

    def run(batch: dict) -> Iterator[dict]:
        doc, text = batch["doc_id"].to_pylist(), texts_of(batch["text"])
        for a, b in runs(text):
            sets = list(shingle_sets(text[a:b]))
            yield {
                "doc_id": doc[a:b],
                "n_shingles": list(map(len, sets)),
                "h1": signed(np.array([mix(s).sum() for s in sets], np.uint64)),
                "h2": signed(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() for s in sets], np.uint64)),
                "sketch": [sketch(s) for s in sets],
                "empties": [[x for k in bands_of(len(s)) for x in (k, empties(s, k))] for s in sets],
            }

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sketch array<bigint>, empties array<int>")


def signature_rows(docs: DataFrame) -> DataFrame:
    """(key, doc_id) of every signature of every document; the low 6 bits of a key are its band."""

    def run(batch: dict) -> Iterator[dict]:
        doc, text = batch["doc_id"].to_pylist(), texts_of(batch["text"])
        for a, b in runs(text):
            keys, ids = [], []
            for i, s in zip(doc[a:b], shingle_sets(text[a:b])):
                for k in bands_of(len(s)):
                    keys.append((signatures(s, k) & np.uint64(0xFFFFFFFFFFFFFFC0)) | np.uint64(k))
                    ids.append(np.full(len(keys[-1]), i, np.int64))
            if keys:
                keys, ids = signed(np.concatenate(keys)), np.concatenate(ids)
                for c in range(0, len(keys), 100_000):
                    yield {"key": keys[c : c + 100_000], "doc_id": ids[c : c + 100_000]}

    return map_batches(docs.select("doc_id", "text"), run, "key bigint, doc_id bigint")


def shared_keys(rows: DataFrame, common: int) -> DataFrame:
    """(key, doc_id, lead, hot) of keys that two or more rows have: lead is the least doc_id, hot whether more than `common` have it.

    Spark sorts the rows, and one pass finds the runs; it holds `common` rows between batches at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a run that may go on and is not yet hot
        hot_key, hot_lead = None, 0  # of a hot run that may go on
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("lead", pa.int64()), ("hot", pa.bool_())])

        def out(key: np.ndarray, doc: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held_key, held_doc, hot_key, hot_lead
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            lead, n = doc[starts], size.copy()
            if hot_key is not None and key[0] == hot_key:
                lead[0], n[0] = hot_lead, common + 1
            keep = np.repeat(n > 1, size)
            if not whole:
                if n[-1] > common:
                    hot_key, hot_lead, held_key, held_doc = key[-1], lead[-1], key[:0], doc[:0]
                else:
                    hot_key, held_key, held_doc = None, key[starts[-1] :], doc[starts[-1] :]
                    keep[starts[-1] :] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(doc[keep]), pa.array(np.repeat(lead, size)[keep]), pa.array(np.repeat(n > common, size)[keep])], schema=schema)

        for batch in batches:
            if batch.num_rows:
                yield from out(np.concatenate([held_key, batch.column(0).to_numpy()]), np.concatenate([held_doc, batch.column(1).to_numpy()]), False)
        if len(held_key):
            yield from out(held_key, held_doc, True)

    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = cut(rows.repartition(n, "key").sortWithinPartitions("key", "doc_id").mapInArrow(run, "key bigint, doc_id bigint, lead bigint, hot boolean"))
    small_batches(spark)
    return out


def of_band(i: int):
    """Item i of the plan of the band in column `band` (64 bands reach sets of some billions)."""
    return F.create_map(*[F.lit(x) for k in range(64) for x in (k, int(plan(k)[i]))])[F.col("band")]


def without_common(shared: DataFrame, bands: DataFrame, n: int) -> DataFrame:
    """shared with (band, size, empty, dropped) of each document, less hot keys where the pigeonhole principle can spare them.

    Linked sets agree in all segments but H at most, so in more than `spare` of
    them, empty ones included. If a document's hot keys and empty segments are no
    more than that, it shares others with each of its partners, and its hot keys
    go; `dropped` is their number, null if the document keeps them.
    """
    shared = shared.withColumn("band", F.col("key").bitwiseAND(63).cast("int"))
    hot = shared.groupBy("doc_id", "band").agg(F.count_if("hot").cast("int").alias("hot_keys"))
    light = (of_band(1) == 0) & (F.col("hot_keys") + F.col("empty") <= of_band(2))
    state = cut(hot.join(bands, ["doc_id", "band"]).select("doc_id", "band", "size", "empty", F.when(light, F.col("hot_keys")).alias("dropped")), n)
    left = cut(shared.join(state, ["doc_id", "band"]).where("not hot or dropped is null"), n)
    leads = left.where("hot").groupBy("key").agg(F.min("doc_id").alias("own_lead"))
    return left.join(leads, "key", "left").withColumn("lead", F.coalesce("own_lead", "lead")).drop("own_lead", "hot")


def least_shared(total, empty, dropped):  # noqa: ANN001, ANN201
    """Keys left that linked sets with `total` elements share at least: segments, less those that they can differ in, that are empty in both, and whose keys were dropped."""
    differ = total - 2 * F.floor((4 * total + 8) / 9)
    return F.when(of_band(1) == 0, F.greatest(F.lit(1), of_band(0) - differ - empty - dropped)).otherwise(1)


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose shingle sets have 100 * intersection >= percent * union."""
    some = only(docs.select("doc_id", "text"), pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "doc_id")
    both = join_hot(pairs, some.toDF("a", "text_a"), "a", "b", hot_keys(pairs, "a"))
    both = join_hot(both, some.toDF("b", "text_b"), "b", "a", hot_keys(pairs, "b"))

    def run(batch: dict) -> Iterator[dict]:
        a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
        ta, tb = texts_of(batch["text_a"]), texts_of(batch["text_b"])
        known: dict[int, np.ndarray] = {}
        good = []
        for i in range(len(a)):
            for d, t in ((a[i], ta[i]), (b[i], tb[i])):
                if d not in known:
                    if len(known) > 200:
                        known.clear()
                    known[d] = next(shingle_sets([t]))
            x, y = (known[d] if d in known else next(shingle_sets([t])) for d, t in ((a[i], ta[i]), (b[i], tb[i])))
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both_in = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both_in >= percent * (len(x) + len(y) - both_in):
                    good.append(i)
        yield {"a": [a[i] for i in good], "b": [b[i] for i in good]}

    checked = map_batches(both.select("a", "b", "text_a", "text_b"), run, "a bigint, b bigint")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")  # a row holds two texts
    out = cut(checked)
    small_batches(docs.sparkSession)
    return out


def near_enough(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sketches do not show more differences than linked sets of their sizes have."""
    own = sets.select("doc_id", "n_shingles", "sketch")
    both = pairs.join(own.toDF("a", "size_a", "sketch_a"), "a").join(own.toDF("b", "size_b", "sketch_b"), "b")
    bits = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    total = F.col("size_a") + F.col("size_b")
    return both.where(bits <= total - 2 * F.floor((4 * total + 8) / 9)).select("a", "b")


def met_in_rare_keys(left: DataFrame) -> DataFrame:
    """(a, b): pairs of different components of which one dropped its common keys, and which share as many of the others as they need.

    Its keys are of a few documents each, so pairs are at most a few for every key and document.
    """
    x, y = left.where("dropped is not null").alias("x"), left.drop("band").alias("y")
    once = F.expr("x.component != y.component and (y.dropped is null or x.doc_id < y.doc_id)") & (5 * F.least("x.size", "y.size") >= 4 * F.greatest("x.size", "y.size"))
    need = least_shared(F.col("x.size") + F.col("y.size"), F.least("x.empty", "y.empty"), F.coalesce(F.least("x.dropped", "y.dropped"), F.lit(0)))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & once).groupBy(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"), "band").agg(F.count(F.lit(1)).alias("n"), F.max(need).alias("need"))
    return met.where("n >= need").select("a", "b")


def with_enough_keys(heavy: DataFrame, n: int) -> DataFrame:
    """heavy (key, doc_id, band, component, size, empty) less documents that share too few keys with other components to link in a band, and `need`, the keys that those left need at least.

    Once is enough for right results; a second time sees what the first has left over.
    """
    for _ in range(KEY_ROUNDS):
        stats = heavy.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("size").alias("largest")).where("least < most").select("key", "largest")
        placed = cut(heavy.drop("need").join(stats, "key"), n)
        own = placed.groupBy("doc_id", "band").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("empty").alias("empty"), F.max("largest").alias("largest"))
        partner = F.least("largest", F.floor(F.col("size") * 5 / 4))
        # a ninth of the elements bounds the differences, and unlike most_differences never falls as they grow
        least = of_band(0) - F.floor((F.col("size") + partner) / 9) - F.col("empty")
        own = own.withColumn("need", F.when(of_band(1) == 0, F.greatest(F.lit(1), least)).otherwise(1).cast("int")).where("n >= need").select("doc_id", "band", "need")
        heavy = cut(placed.drop("largest").join(own, ["doc_id", "band"]), n)
    return heavy


def met_in_common_keys(heavy: DataFrame, docs: DataFrame, percent: int, common: int, n: int) -> DataFrame:
    """(a, b): pairs of different components among documents that kept their common keys (key, doc_id, band, component, size, empty).

    Documents of a common key have its most central document, the one with most
    documents in its keys, as lead, and are paired by their differences to it.
    Two documents that share `need` of their keys share one of the first
    K + 1 - need of each one's K keys in one order of all keys; only these count.
    Keys of the most central leads come first, so that few leads serve all keys.
    """
    heavy = with_enough_keys(heavy, n)
    sizes = cut(heavy.groupBy("key").agg(F.count(F.lit(1)).alias("n")), n)
    score = heavy.join(sizes.where(F.col("n") > common), "key").groupBy("doc_id").agg(F.sum("n").alias("score"))
    scored = cut(heavy.join(score, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0))), n)
    central = scored.groupBy("key").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("lead"), F.max("score").alias("lead_score"), (F.count(F.lit(1)) > common).alias("hot"))
    w = Window.partitionBy("doc_id", "band")  # a document's keys in a band, one for each segment
    place = F.row_number().over(w.orderBy(F.desc("hot"), F.desc("lead_score"), "lead", "key"))
    early = cut(scored.join(central, "key").withColumn("place", place).withColumn("keys", F.count(F.lit(1)).over(w)).where("place <= keys + 1 - need"), n)
    around = pairs_around_leads(early.where("hot").select("lead", "doc_id", "component"), docs, percent)
    x, y = early.where("not hot").alias("x"), early.where("not hot").alias("y")
    few = x.join(y, F.expr("x.key = y.key and x.component != y.component and x.doc_id < y.doc_id and 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size)"))
    return around.union(few.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")))


def linked(shared: DataFrame, sets: DataFrame, docs: DataFrame, percent: int, common: int, n: int) -> DataFrame:
    """(node, component) of documents with links, as all links connect them.

    First each document is paired with the lead that it shares most keys with.
    Then all pairs that are not connected and may link are tried: by the number of
    keys they share, or, where keys are common, by their differences to a lead;
    sketches tell most of those that are not near enough.
    """
    shared = cut(shared, n)
    own = least_shared(2 * F.col("size"), F.col("empty"), F.coalesce("dropped", F.lit(0)))
    lead_counts = shared.where("doc_id != lead").groupBy("doc_id", "lead", "band").agg(F.count(F.lit(1)).alias("n"), F.max(own).alias("need")).where("2 * n >= need")
    best = lead_counts.groupBy("doc_id").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("lead"))
    tried = cut(best.select(F.col("lead").alias("a"), F.col("doc_id").alias("b")), n)
    links = verified(tried, docs, percent)
    nodes = cut(components(links, "a", "b"))
    placed = shared.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    left = cut(placed.join(split, "key").select("key", "doc_id", "band", "component", "size", "empty", "dropped"), n)
    pairs = met_in_rare_keys(left).union(met_in_common_keys(left.where("dropped is null").drop("dropped"), docs, percent, common, n)).distinct()
    pairs = cut(near_enough(pairs.join(tried, ["a", "b"], "left_anti"), sets))
    if pairs.isEmpty():
        return nodes
    return components(links.union(verified(pairs, docs, percent)), "a", "b")


def similar_groups(docs: DataFrame, percent: int = PERCENT, common: int = COMMON) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Sets are the distinct five-word shingles of the lower-cased text; fewer words
    are one shingle, and a null text or one without words has the empty set,
    which links with nothing. Documents with equal sets are linked, and one stands
    for all of them. doc_id is taken as a key; rows with a null id are their
    own component. Components are those of all links.
    """
    assert percent >= 80, "bands and segments are laid out for 80 % or more"
    sets = cut(set_table(docs))
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("n"))
    repeated = cut(classes.where("n > 1").select("n_shingles", "h1", "h2", "lead"))
    copies = cut(sets.where("n_shingles > 0 and doc_id is not null").join(repeated, ["n_shingles", "h1", "h2"]).select("doc_id", "lead").distinct())
    others = copies.where("doc_id != lead").select("doc_id").distinct()
    bare = docs.select("doc_id", "text").where("doc_id is not null")
    firsts = bare.join(F.broadcast(others) if others.count() <= 2_000_000 else others, "doc_id", "left_anti")
    pairs = F.explode(F.expr("transform(sequence(0, size(empties) div 2 - 1), i -> struct(empties[2 * i] AS band, empties[2 * i + 1] AS empty))"))
    bands = sets.where("n_shingles > 3").select("doc_id", F.col("n_shingles").cast("int").alias("size"), pairs.alias("b")).select("doc_id", "size", "b.*")
    shared = shared_keys(signature_rows(firsts), common)
    n = shared.count()
    top = linked(without_common(shared, bands, n), sets, firsts, percent, common, n)
    copied = copies.join(top.select(F.col("node").alias("lead"), "component"), "lead", "left").select("doc_id", F.coalesce("component", "lead").alias("component"))
    place = cut(copied.union(top.join(copies, top["node"] == copies["doc_id"], "left_anti").select(F.col("node").alias("doc_id"), "component")))
    return sets.join(place.groupBy("doc_id").agg(F.min("component").alias("component")), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stand for their group: the least doc_id of each, and all rows without words or id."""
    groups = similar_groups(docs, percent)
    others = cut(groups.where("doc_id != component_id").select("doc_id").distinct())
    return docs.join(F.broadcast(others) if others.count() <= 2_000_000 else others, "doc_id", "left_anti")
