"""Ranks, quantiles and dominance counts of long series, with no task that holds a whole group."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship

#: Relative rank error of the sketches that bracket a quantile, as its inverse.
ACCURACY = 10_000
#: Groups whose brackets are sent to every task; more are joined by a shuffle.
SMALL_GROUPS = 100_000
#: Points that are compared in one task; a block of a longer series grows with the root of its length.
BLOCK = 1024


def same(left: str, right: str, cols: list[str]) -> Column:
    """Equality of cols of two aliased sides, nulls equal to nulls."""
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols], F.lit(True))


def sent(df: DataFrame, n: int | None = None) -> DataFrame:
    """df, a written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if (df.count() if n is None else n) <= SMALL_GROUPS else df


def distribution(df: DataFrame, by: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Every different value of each group with its weight `n` (rows, or a sum) and `before`, the weight of all smaller ones. Nulls are left out.

    Rows of one value combine before they are sorted into ranges, and ranges
    add up their sums, so a hot group is many tasks and a hot value one row.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.lit(1) if weight is None else weight).cast("bigint").alias("n"))
    rows = cut(rows.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy(*by, "_part").agg(F.sum("n").alias("_sum"))
    parts = parts.withColumn("_start", F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_sum")).drop("_sum")
    inside = F.sum("n").over(Window.partitionBy(*by, "_part").orderBy(value)) - F.col("n")
    both = rows.withColumn("_inside", inside).alias("r").join(parts.alias("p"), same("r", "p", [*by, "_part"]))
    return both.select(*[F.col(f"r.{c}").alias(c) for c in [*by, value, "n"]], (F.col("_start") + F.col("_inside")).alias("before"))


def quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column q<percent> each; null for a group without values.

    A mergeable sketch brackets the ranks of each quantile, a pass counts what
    lies below and inside every bracket, and only what is inside is sorted.
    Where a sketch missed its ranks, which the counts show, all of the group
    is inside. The values are written once: computed anew for every pass, sums
    of doubles may differ in their last bit, and a bracket then lacks its ends.
    """
    names = [f"q{round(q * 100)}" for q in qs]
    edges = [min(1.0, max(0.0, q + d)) for q in qs for d in (-2 / ACCURACY, 2 / ACCURACY)]
    rows = cut(df.select(*by, F.col(value).cast("double").alias("_v")))
    groups = cut(rows.groupBy(*by).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, edges)), F.lit(ACCURACY)).alias("_e")))
    few = groups.count()
    both = rows.where("_v is not null").alias("r").join(sent(groups, few).alias("g"), same("r", "g", by)).select(*[F.col(f"r.{c}").alias(c) for c in by], "_v", "_n", "_e")
    low, high = [F.col("_e")[2 * i] for i in range(len(qs))], [F.col("_e")[2 * i + 1] for i in range(len(qs))]
    counts = both.groupBy(*by).agg(*[x for i in range(len(qs)) for x in (F.count_if(F.col("_v") < low[i]).alias(f"_b{i}"), F.count_if(F.col("_v") <= high[i]).alias(f"_u{i}"))])
    placed = groups.alias("g").join(counts.alias("c"), same("g", "c", by), "left").select(*[F.col(f"g.{c}").alias(c) for c in by], "_n", "_e", *[f"{x}{i}" for i in range(len(qs)) for x in ("_b", "_u")])
    at = [F.lit(q) * (F.col("_n") - 1) for q in qs]
    held = [(F.col(f"_b{i}") <= F.floor(at[i])) & (F.col(f"_u{i}") > F.ceil(at[i])) for i in range(len(qs))]
    infinite = F.lit(float("inf"))
    bracket = [F.struct(F.lit(i).alias("i"), F.when(held[i], low[i]).otherwise(-infinite).alias("low"), F.when(held[i], high[i]).otherwise(infinite).alias("high"), F.when(held[i], F.col(f"_b{i}")).otherwise(0).alias("below"), at[i].alias("at")) for i in range(len(qs))]
    placed = cut(placed.select(*by, "_n", F.array(*bracket).alias("_k")))
    near = rows.where("_v is not null").alias("r").join(sent(placed, few).alias("g"), same("r", "g", by))
    inside = near.select(*[F.col(f"r.{c}").alias(c) for c in by], "_v", F.explode(F.filter("_k", lambda k: (F.col("_v") >= k["low"]) & ((F.col("_v") <= k["high"]) | (k["high"] == infinite)))).alias("_k"))
    found = distribution(inside.select(*by, F.col("_k.i").alias("_i"), "_v"), [*by, "_i"], "_v")
    known = placed.select(*by, F.explode("_k").alias("_k")).select(*by, F.col("_k.i").alias("_i"), "_k.below", "_k.at")
    hit = found.alias("f").join(sent(known, few * len(qs)).alias("k"), same("f", "k", [*by, "_i"]))
    start = F.col("below") + F.col("before")
    holds = lambda rank: (start <= rank) & (rank < start + F.col("n"))
    ends = hit.groupBy(*[F.col(f"f.{c}").alias(c) for c in by], F.col("f._i").alias("_i")).agg(F.max(F.when(holds(F.floor("at")), F.col("_v"))).alias("_lo"), F.max(F.when(holds(F.ceil("at")), F.col("_v"))).alias("_hi"), F.first("at").alias("_at"))
    ends = ends.withColumn("_q", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))))
    wide = ends.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(names)])
    return placed.alias("g").join(wide.alias("w"), same("g", "w", by), "left").select(*[F.col(f"g.{c}").alias(c) for c in by], *names)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    i = x.view(np.int64)
    return np.where(i < 0, np.int64(-(2**63)) - i, i)


def _double(i: np.ndarray) -> np.ndarray:
    return np.where(i < 0, np.int64(-(2**63)) - i, i).view(np.float64)


def least_reaching(mean: np.ndarray, limit: float, strictly: bool) -> np.ndarray:
    """The least double r with mean + r >= limit (strictly: > limit), as sums of doubles round; by bisection, as the sum never falls in r."""
    lo = np.full(len(mean), _ordered(np.array([-np.finfo(float).max]))[0])
    hi = np.full(len(mean), _ordered(np.array([np.inf]))[0])
    while (lo < hi).any():
        mid = (lo & hi) + ((lo ^ hi) >> 1)
        total = mean + _double(mid)
        there = total > limit if strictly else total >= limit
        hi, lo = np.where(there, mid, hi), np.where(there | (lo >= hi), lo, mid + 1)
    return _double(hi)


def counts_of_sums(points: DataFrame, residuals: DataFrame, by: list[str], mean: str, residual: str, limit: float) -> DataFrame:
    """points with `n`, the residuals of the same group, and of these `below` (mean + residual < -limit) and `above` (> limit); nulls without residuals or mean.

    Two lookups in the sorted distribution of the residuals: points meet one
    row each, never the residuals themselves.
    """
    ship(points.sparkSession)

    @F.pandas_udf("down double, up double")
    def limits(m: pd.Series) -> pd.DataFrame:
        x = m.to_numpy(float)
        known = lambda r: np.where(np.isfinite(x), r, np.nan)
        return pd.DataFrame({"down": known(least_reaching(x, -limit, False)), "up": known(least_reaching(x, limit, True))})

    number = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    asked = cut(points.withColumn("_at", limits(F.col(mean).cast("double"))).withColumns({"_down": number(F.col("_at.down")), "_up": number(F.col("_at.up"))}).drop("_at"))
    known = residuals.select(*by, F.col(residual).cast("double").alias("_x"))
    probes = [asked.select(*by, F.col(c).alias("_x"), F.lit(0).alias("_w")) for c in ("_down", "_up")]
    table = cut(distribution(known.withColumn("_w", F.lit(1)).unionByName(probes[0]).unionByName(probes[1]), by, "_x", F.col("_w")))
    totals = known.where("_x is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    out = asked.alias("a").join(totals.alias("t"), same("a", "t", by), "left").select(*[F.col(f"a.{c}").alias(c) for c in asked.columns], F.col("t.n").alias("n"))
    for probe, name in (("_down", "_less"), ("_up", "_most")):
        place = table.select(*by, F.col("_x").alias(probe), F.col("before").alias(name))
        out = out.alias("a").join(place.alias("p"), same("a", "p", [*by, probe]), "left").select(*[F.col(f"a.{c}").alias(c) for c in out.columns], F.col(f"p.{name}").alias(name))
    return out.select(*points.columns, "n", F.when(F.col("n") > 0, F.col("_less")).alias("below"), (F.col("n") - F.col("_most")).alias("above"))


def dominated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each point the weight of the points that are smaller in both x and y.

    Bit by bit of the rank in x: two points that first differ in a bit are
    compared there, by sums along y.
    """
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length()):
        group = rank >> (bit + 1)
        by = np.lexsort((y, group))
        g, z, one = group[by], y[by], (rank[by] >> bit & 1).astype(bool)
        run = np.concatenate([[0], np.cumsum(np.where(one, 0, weight[by]))])
        fresh = np.concatenate([[True], g[1:] != g[:-1]])
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # of the group
        tie = np.flatnonzero(new := np.concatenate([[True], (g[1:] != g[:-1]) | (z[1:] != z[:-1])]))[np.cumsum(new) - 1]  # of the points of one y
        out[by] += np.where(one, run[tie] - run[first], 0)
    return out


def earlier_and_smaller(df: DataFrame, by: list[str], order: str, value: str, block: int | None = None) -> DataFrame:
    """df (by, order, value) with `earlier`, the rows of a strictly smaller order that have a value, and `smaller`, those of them with a smaller value; null for a null value.

    Rows are put in blocks by their rank in each of the two. Whole blocks
    that lie before in both are one look into sums over the grid of blocks,
    which is no larger than the rows; the rest are points of the own column
    or row of the grid, counted exactly in groups of about a block.
    """
    spark = df.sparkSession
    ship(spark)
    rows = cut(df.select(*by, F.col(order).alias("_o"), F.col(value).alias("_v")))
    times = cut(distribution(rows, by, "_o", F.col("_v").isNotNull().cast("int")).withColumnRenamed("before", "_t"))
    values = distribution(rows, by, "_v").withColumnRenamed("before", "_y")
    if block is None:
        longest = times.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        block = max(BLOCK, int(longest**0.5) + 1)
    joined = rows.where("_v is not null").groupBy(*by, "_o", "_v").agg(F.count(F.lit(1)).alias("_c")).alias("r").join(times.alias("t"), same("r", "t", [*by, "_o"])).select(*[F.col(f"r.{c}").alias(c) for c in [*by, "_o", "_v", "_c"]], "_t")
    points = joined.alias("r").join(values.alias("t"), same("r", "t", [*by, "_v"])).select(*[F.col(f"r.{c}").alias(c) for c in [*by, "_o", "_v", "_c", "_t"]], "_y")
    points = cut(points.withColumns({"_i": F.floor(F.col("_t") / block), "_j": F.floor(F.col("_y") / block)}))

    cells = points.groupBy(*by, "_i", "_j").agg(F.sum("_c").alias("_n"))
    sides = points.groupBy(*by).agg(F.max("_j").alias("_most"))
    lines = points.select(*by, "_i").distinct().alias("l").join(sides.alias("s"), same("l", "s", by)).select(*[F.col(f"l.{c}").alias(c) for c in [*by, "_i"]], F.explode(F.sequence(F.lit(0).cast("bigint"), "_most")).alias("_j"))
    grid = lines.alias("l").join(cells.alias("c"), same("l", "c", [*by, "_i", "_j"]), "left").select(*[F.col(f"l.{c}").alias(c) for c in [*by, "_i", "_j"]], F.coalesce("_n", F.lit(0)).alias("_n"))
    past = lambda over, by_what, what: F.coalesce(F.sum(what).over(Window.partitionBy(*by, over).orderBy(by_what).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumn("_n", past("_j", "_i", "_n")).withColumn("_whole", past("_i", "_j", "_n"))

    # groups of one column of the grid (kind 0), and of one row of it (kind 1), whose last order may be many points that need not meet each other
    column = points.select(*by, F.lit(0).alias("_kind"), F.col("_j").alias("_g"), F.lit(0).alias("_s"), F.lit(True).alias("_own"), F.col("_i").alias("_x"), "_y", "_c", F.col("_t").alias("_t"))
    last = points.groupBy(*by, "_i").agg(F.max("_t").alias("_last"), F.count(F.lit(1)).alias("_m")).withColumn("_parts", F.floor(F.col("_m") / (4 * block)).cast("int") + 1)
    row = points.alias("p").join(last.alias("l"), same("p", "l", [*by, "_i"])).select(*[F.col(f"p.{c}").alias(c) for c in points.columns], "_last", "_parts")
    dealt = F.when(F.col("_t") == F.col("_last"), F.array(F.pmod(F.hash("_y"), F.col("_parts")))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
    row = row.withColumn("_s", F.explode(dealt)).select(*by, F.lit(1).alias("_kind"), F.col("_i").alias("_g"), "_s", ((F.col("_t") == F.col("_last")) | (F.col("_s") == 0)).alias("_own"), F.col("_t").alias("_x"), "_y", "_c", "_t")

    def count(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(_below=dominated(p["_x"].to_numpy(), p["_y"].to_numpy(), p["_c"].to_numpy()))
        return p[p["_own"]][[*by, "_t", "_y", "_below"]]

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "_t bigint", "_y bigint", "_below bigint"])
    every = column.unionByName(row).groupBy(*by, "_kind", "_g", "_s").applyInPandas(count, schema)
    near = every.groupBy(*by, "_t", "_y").agg(F.sum("_below").alias("_below"))
    total = points.alias("p").join(near.alias("n"), same("p", "n", [*by, "_t", "_y"])).select(*[F.col(f"p.{c}").alias(c) for c in points.columns], "_below")
    total = total.alias("p").join(grid.alias("g"), same("p", "g", [*by, "_i", "_j"])).select(*[F.col(f"p.{c}").alias(c) for c in [*by, "_o", "_v"]], (F.col("_below") + F.col("_whole")).alias("_smaller"))
    out = rows.alias("r").join(times.alias("t"), same("r", "t", [*by, "_o"])).select(*[F.col(f"r.{c}").alias(c) for c in [*by, "_o", "_v"]], F.col("_t").alias("earlier"))
    out = out.alias("r").join(total.alias("t"), same("r", "t", [*by, "_o", "_v"]), "left")
    return out.select(*[F.col(f"r.{c}").alias(c) for c in by], F.col("r._o").alias(order), F.col("r._v").alias(value), "earlier", F.col("t._smaller").alias("smaller"))
