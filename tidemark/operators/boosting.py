"""Boosted trees for quantiles: pinball loss on histogram sums that Spark aggregates, all levels and groups of rows in the same jobs."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranks import quantiles, same

#: Cells of a feature's histogram, and rows that either side of a split must have.
CELLS, LEAST_ROWS = 32, 20

#: A tree of depth two: the first split, those of its two sides, and what its four leaves add. A split is (feature, cell): at most that cell goes left; feature -1 is no split.
_TREE = "struct<f0: int, b0: int, fl: int, bl: int, fr: int, br: int, add: array<double>>"


def _cells(df: DataFrame, by: list[str], features: list[str], edges: DataFrame) -> DataFrame:
    """df with `_b`, the cell of each feature by the edges of its group; a null or NaN is below all edges."""
    cell = lambda i, c: F.coalesce(F.size(F.filter(F.col("_edges")[i], lambda e: e < F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))), F.lit(0))
    both = df.alias("d").join(F.broadcast(edges).alias("e"), same("d", "e", by), "left").select("d.*", "_edges")
    return both.withColumn("_b", F.array(*[cell(i, c) for i, c in enumerate(features)])).drop("_edges")


def _goes_right(feature: Column, cell: Column) -> Column:
    return F.when(feature < 0, False).otherwise(F.get("_b", feature) > cell)


def _leaf(tree: Column) -> Column:
    """The leaf (0 to 3) of a tree that a row with cells `_b` falls into."""
    right = _goes_right(tree["f0"], tree["b0"])
    below = F.when(right, _goes_right(tree["fr"], tree["br"])).otherwise(_goes_right(tree["fl"], tree["bl"]))
    return right.cast("int") * 2 + below.cast("int")


def _best_splits(rows: DataFrame, node: list[str]) -> dict[tuple, tuple[int, int]]:
    """For each node the split whose sides' gradients differ most, from sums over its histograms: as many rows as models, features and cells."""
    cells = rows.select(*node, "_g", F.posexplode("_b").alias("_feature", "_cell")).groupBy(*node, "_feature", "_cell").agg(F.sum("_g").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    sums: dict[tuple, list] = defaultdict(list)
    for r in cells.collect():
        sums[(*[r[c] for c in node], r["_feature"])].append((r["_cell"], r["_sum"], r["_n"]))
    best: dict[tuple, tuple] = {}
    for (*key, f), own in sums.items():
        own.sort()
        g, n = sum(x[1] for x in own), sum(x[2] for x in own)
        left_g = left_n = 0.0
        for b, cell_g, cell_n in own[:-1]:
            left_g, left_n = left_g + cell_g, left_n + cell_n
            if min(left_n, n - left_n) >= LEAST_ROWS:
                gain = left_g**2 / left_n + (g - left_g) ** 2 / (n - left_n) - g**2 / n
                if gain > 1e-12 and gain > best.get(tuple(key), (0,))[0]:
                    best[tuple(key)] = (gain, f, b)
    return {k: (f, b) for k, (_, f, b) in best.items()}


def fit_quantiles(train: DataFrame, test: DataFrame, by: list[str], features: list[str], label: str, levels: list[float], rounds: int = 12, rate: float = 0.3) -> DataFrame:
    """test with `quantiles`, an array of the label's predicted quantiles at levels, in rising order; null where its group has no labelled rows in train.

    Every level of every group is a model of its own, which starts at the
    exact quantile. A round sums the loss's gradient in histograms of each
    model, splits twice, and moves each leaf by `rate` of the level's quantile
    of what its rows lack. Only histograms, splits and leaves reach the
    driver: their number is that of models, features and cells. Rows are read
    four times a round and written once.
    """
    spark = train.sparkSession
    inner = [i / CELLS for i in range(1, CELLS)]
    known = cut(train.where(F.col(label).isNotNull()).select(*by, *features, F.col(label).cast("double").alias("_y")))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    edges = known.groupBy(*by).agg(F.array(*[F.coalesce(F.array_distinct(F.percentile_approx(number(c), F.array(*map(F.lit, inner)), F.lit(10_000))), F.array().cast("array<double>")) for c in features]).alias("_edges"))
    edges = cut(edges)
    names = [f"q{round(q * 100)}" for q in levels]
    first = quantiles(known, by, "_y", levels)
    starts = cut(first.select(*by, F.posexplode(F.array(*[F.struct(F.lit(q).alias("_level"), F.col(c).alias("_at")) for q, c in zip(levels, names)])).alias("_k", "_s")).select(*by, "_k", "_s._level", "_s._at"))
    model = [*by, "_k"]
    state = _cells(known, by, features, edges).alias("d").join(F.broadcast(starts).alias("s"), same("d", "s", by)).select(*[F.col(f"d.{c}").alias(c) for c in by], "_k", "_level", "_y", "_b", F.col("_at").alias("_f"))
    state, forest = cut(state), defaultdict(list)
    models = [tuple(r) for r in starts.select(*model).collect()]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in starts.select(*model).schema)
    for _ in range(rounds):
        state = state.withColumn("_g", F.col("_level") - (F.col("_y") < F.col("_f")).cast("int"))
        top = _best_splits(state, model)
        trees = [(*m, (*top.get(m, (-1, 0)), -1, 0, -1, 0, [0.0] * 4)) for m in models]
        of = lambda t: F.broadcast(spark.createDataFrame(t, f"{kinds}, _t {_TREE}")).alias("t")
        join = lambda t: state.alias("d").join(of(t), same("d", "t", model)).select("d.*", "_t")
        side = join(trees).withColumn("_right", _goes_right(F.col("_t.f0"), F.col("_t.b0")))
        low = _best_splits(side, [*model, "_right"])
        trees = [(*m, (*top.get(m, (-1, 0)), *low.get((*m, False), (-1, 0)), *low.get((*m, True), (-1, 0)), [0.0] * 4)) for m in models]
        lack = join(trees).select(*model, _leaf(F.col("_t")).alias("_leaf"), (F.col("_y") - F.col("_f")).alias("_d"))
        leaves = {(*[r[c] for c in model], r["_leaf"]): r["_q"][r["_k"]] for r in lack.groupBy(*model, "_leaf").agg(F.percentile_approx("_d", F.array(*map(F.lit, levels)), F.lit(10_000)).alias("_q")).collect()}
        trees = [(*t[:-1], (*t[-1][:-1], [rate * float(leaves.get((*t[:-1], i), 0.0)) for i in range(4)])) for t in trees]
        for t in trees:
            forest[t[:-1]].append(t[-1])
        state = cut(join(trees).withColumn("_f", F.col("_f") + F.get("_t.add", _leaf(F.col("_t")))).drop("_t", "_g"))
    grown = spark.createDataFrame([(*m, forest[m]) for m in models], f"{kinds}, _trees array<{_TREE}>")
    whole = starts.alias("s").join(F.broadcast(grown).alias("g"), same("s", "g", model)).groupBy(*[F.col(f"s.{c}").alias(c) for c in by]).agg(F.array_sort(F.collect_list(F.struct("s._k", "_at", "_trees"))).alias("_models"))
    asked = _cells(test, by, features, edges).alias("d").join(F.broadcast(whole).alias("w"), same("d", "w", by), "left").select("d.*", "_models")
    value = lambda m: F.aggregate(m["_trees"], m["_at"], lambda at, t: at + F.get(t["add"], _leaf(t)))
    return asked.select(*test.columns, F.array_sort(F.transform("_models", value)).alias("quantiles"))
