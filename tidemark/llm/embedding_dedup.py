"""Near-duplicate embeddings by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, map_batches
from .components import components

THRESHOLD = 0.98
TILE_ROWS = 1024
#: Leading dimensions after which a tile is tested, besides all of them.
STEPS = (4, 8, 16, 32)
#: Pairs whose exact cosine is taken at once.
EXACT_PAIRS = 1 << 16
SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length, the places and double vectors (as rows) of those that can link: not null, not zero, all components there and finite."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # a null component is NaN
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        x = values[starts[at][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        if good.any():
            at, x = at[good], x[good]
            # by a power of two, which is exact, so that squares neither overflow nor vanish
            yield at, np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def second_moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, the summed outer products of the unit vectors; Spark adds them up, d * d numbers come back."""

    def run(batch: dict) -> Iterator[dict]:
        for _, x in usable(batch["embedding"]):
            u, d = unit(x), x.shape[1]
            yield {"d": [d] * (d * d), "cell": np.arange(d * d), "v": (u.T @ u).ravel()}

    got = map_batches(vectors.select("embedding"), run, "d int, cell int, v double").groupBy("d", "cell").agg(F.sum("v").alias("v")).toPandas()
    return {int(d): g.sort_values("cell")["v"].to_numpy().reshape(d, d) for d, g in got.groupby("d")}


def bases(moments: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Principal axes as columns, the one with the largest variance first."""
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in moments.items()}


#: Tiles that follow each other, which go to a task together: each body travels once for so many pairs.
GROUP_TILES_LOG2 = 3
FOUND = pa.schema([("cls", pa.int64()), ("rep", pa.int64()), ("n_links", pa.int64()), ("to_rep", pa.int64())])


def group_of(tile: str) -> Column:
    return F.shiftright(tile, GROUP_TILES_LOG2)


TILE = "label string, d int, tile bigint, low double, high double, n int, ids binary, vectors binary"
#: Classes of equal vectors whose members may be joined by sending the classes to every task (40 bytes each).
FEW_CLASSES = 500_000


def number_type(vectors: DataFrame) -> str:
    """Components travel as they are stored: float as 4 bytes, others as 8."""
    return "f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"


def placed_vectors(vectors: DataFrame, basis: dict[int, np.ndarray]) -> DataFrame:
    """The vectors that can link, as bytes, with their place on the first axis and a digest that equal ones share."""

    kind = number_type(vectors)

    def place(batch: dict) -> Iterator[dict]:
        for at, x in usable(batch["embedding"]):
            d = x.shape[1]
            yield {"label": batch["label"].take(pa.array(at)), "d": [d] * len(at), "first": unit(x) @ basis[d][:, 0], "vec_id": batch["vec_id"].take(pa.array(at)), "vector": [v.tobytes() for v in x.astype(kind)]}

    placed = map_batches(vectors.where("label is not null").select("vec_id", "label", "embedding"), place, "label string, d int, first double, vec_id bigint, vector binary")
    return cut(placed.withColumn("digest", F.sha2("vector", 256)))


def classes_of(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors of a label as one class (cls, label, d, first, rep, n, vector), and its members (vec_id, cls, rep, n).

    rep is the least vec_id. Vectors are aggregated before they are dealt out, so
    a class of any size stays one row.
    """
    by = ["label", "d", "digest"]
    classes = placed.groupBy(*by).agg(F.min("first").alias("first"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("vector").alias("vector"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    several = classes.where("n > 1").select(*by, "cls", "rep", "n")
    single = classes.where("n = 1").select(F.col("rep").alias("vec_id"), "cls", "rep", "n")
    few = several.count() <= FEW_CLASSES
    return classes, single.union(placed.select("vec_id", *by).join(F.broadcast(several) if few else several, by).select("vec_id", "cls", "rep", "n"))


def tiles(classes: DataFrame) -> DataFrame:
    """Blocks of up to TILE_ROWS classes of one label, neighbours on the first axis; ids holds cls, rep and n of each."""

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = classes.repartitionByRange(n, "label", "d", "first", "cls").sortWithinPartitions("label", "d", "first", "cls")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ("label", "d", "tile", "low", "high", "n", "ids", "vectors")
        kinds = pa.schema([("label", pa.string()), ("d", pa.int32()), ("tile", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
        made = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, rows
            label, d, *_ = rows[0]
            first = [r[2] for r in rows]
            out = dict(zip(names, (label, d, made, min(first), max(first), len(rows), np.array([r[3:6] for r in rows], np.int64).tobytes(), b"".join(r[6] for r in rows))))
            made, rows = made + 1, []
            return pa.RecordBatch.from_pylist([out], schema=kinds)

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("label", "d", "first", "cls", "rep", "n", "vector"))):
                if rows and (len(rows) == TILE_ROWS or rows[0][:2] != r[:2]):
                    yield flush()
                rows.append(r)
        if rows:
            yield flush()

    return ordered.mapInArrow(block, TILE)


def tile_links(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) with cosine >= threshold, in blocks; if same, only those with row of a < row of b.

    Products of the leading principal dimensions are added up step by step; what
    the others can add is at most the product of the suffix norms, and rows and
    columns with no pair that can still reach the threshold are dropped. What
    is left is decided by the cosine of the vectors themselves, in double.
    """
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ basis, ub @ basis
    tail = lambda r: np.sqrt(np.maximum(np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1], 0))
    ta, tb = tail(ra), tail(rb)
    rows, cols, d = np.arange(len(a)), np.arange(len(b)), basis.shape[0]
    total, done = np.zeros((len(a), len(b))), 0
    alive = np.triu(np.ones((len(a), len(b)), bool), 1) if same else np.ones((len(a), len(b)), bool)
    for k in [*[s for s in STEPS if s < d], d]:
        total += ra[rows, done:k] @ rb[cols, done:k].T
        bound = total + (np.outer(ta[rows, k], tb[cols, k]) if k < d else 0)
        alive &= bound >= threshold - SLACK
        keep_r, keep_c = alive.any(axis=1), alive.any(axis=0)
        if not keep_r.any():
            return
        rows, cols, total, alive, done = rows[keep_r], cols[keep_c], total[np.ix_(keep_r, keep_c)], alive[np.ix_(keep_r, keep_c)], k
    i, j = np.nonzero(alive)
    i, j = rows[i], cols[j]
    na, nb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    for s in range(0, len(i), EXACT_PAIRS):
        x, y = i[s : s + EXACT_PAIRS], j[s : s + EXACT_PAIRS]
        good = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
        yield x[good], y[good]


def unite(least: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """least holds the smallest row that each row is connected to; the same after links i-j."""
    while True:
        x, y = least[i], least[j]
        if (x == y).all():
            return least
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]


def compare(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> dict:
    """Per class (cls, rep, n in ids) with links to others: the vectors of those in this pair of tiles, and the rep of one that it is connected to (never all pairs)."""
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    shift, counts, least = 0 if same else len(ids_a), np.zeros(len(ids), np.int64), np.arange(len(ids))
    weight = ids[:, 2].astype(float)  # sums below 2**53 are exact
    for i, j in tile_links(a, b, basis, threshold, same):
        j = j + shift
        counts += (np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))).astype(np.int64)
        least = unite(least, i, j)
    at = np.flatnonzero(counts)
    return {"cls": ids[at, 0], "rep": ids[at, 1], "n_links": counts[at], "to_rep": ids[least[at], 1]}


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding, label).

    Rows link if their labels, of any type that casts to a string, are equal
    as strings and not null and their cosine is at least threshold. Rows whose embedding is null, zero, or holds null or
    non-finite components link with nothing, nor do embeddings of different
    lengths. Equal vectors of a label are compared as one class with their number.
    Rows of one vec_id are other vectors, but one node of the links: each of
    them gets the sum of their links. Rows with a null id link with nothing,
    have no component and are kept. An empty table gives no rows; other columns
    are not read.
    """
    vectors = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    basis = bases(second_moments(vectors))
    classes, members = classes_of(placed_vectors(vectors.where("vec_id is not null"), basis))
    blocks = cut(tiles(classes))
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) + SLACK  # unit vectors with that cosine are no further apart on any axis
    near = blocks.select("label", "d", "tile", "low", "high").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / reach), F.floor((F.col("high") + reach) / reach))))
    x, y = near.alias("x"), near.alias("y")
    pairs = (
        x.join(y, ["label", "d", "cell"])
        .where((F.col("x.tile") <= F.col("y.tile")) & (F.col("y.low") <= F.col("x.high") + reach) & (F.col("x.low") <= F.col("y.high") + reach))
        .select(F.col("x.tile").alias("a"), F.col("y.tile").alias("b")).distinct()
    )
    kind = number_type(vectors)

    def run(table: pa.Table) -> pa.Table:
        """All pairs of tiles in reach, of one group of tiles or between two; a tile is read once for all its pairs."""
        left = [(r, *body_of(r)) for r in table.to_pylist()]
        found: dict[str, list] = {c: [] for c in FOUND.names}
        for i, (x, ids_x, rows_x) in enumerate(left):
            for y, ids_y, rows_y in left[i:]:
                apart = x["a"] != x["b"] and x["side"] == y["side"]
                if apart or (x["label"], x["d"]) != (y["label"], y["d"]) or y["low"] > x["high"] + reach or x["low"] > y["high"] + reach:
                    continue
                got = compare(ids_x, rows_x, ids_y, rows_y, basis[x["d"]], threshold, x["tile"] == y["tile"])
                for c in FOUND.names:
                    found[c].append(got[c])
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in found.items()}, FOUND)

    def body_of(r: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(r["ids"], np.int64).reshape(-1, 3), np.frombuffer(r["vectors"], kind).astype(float).reshape(-1, r["d"])

    groups = pairs.select(group_of("a").alias("a"), group_of("b").alias("b")).distinct()
    sides = groups.select("a", "b", F.explode(F.expr("if(a = b, array(0), array(0, 1))")).alias("side")).withColumn("group", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
    bodies = cut(sides).join(blocks.withColumn("group", group_of("tile")), "group").select("a", "b", "side", "tile", "label", "d", "low", "high", "ids", "vectors")
    found = cut(bodies.groupBy("a", "b").applyInArrow(run, "cls bigint, rep bigint, n_links bigint, to_rep bigint"))
    per_class = found.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    linked = members.join(per_class, "cls", "left").where("n > 1 or n_links is not null")
    counts = linked.groupBy("vec_id").agg(F.sum(F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    nodes = components(found.select(F.col("rep").alias("a"), F.col("to_rep").alias("b")).union(members.where("vec_id != rep").select("rep", "vec_id")), "a", "b")
    result = vectors.select("vec_id").join(counts, "vec_id", "left").join(nodes.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
