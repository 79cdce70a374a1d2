"""k nearest neighbours on one scalar."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship


def nearest(xs: np.ndarray, ref: np.ndarray, turn: np.ndarray, k: int, below: bool, above: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """For each of xs the places of the k nearest of ref (rising), of equal distance those first in turn; and whether rows outside of ref may tie with them, of which there are some below or above."""
    found, open_ = [], np.zeros(len(xs), bool)
    for i, (x, at) in enumerate(zip(xs, np.searchsorted(ref, xs))):
        lo, hi = max(0, at - k), min(len(ref), at + k)
        d = np.abs(x - ref[lo:hi])
        last = np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
        while lo > 0 and abs(x - ref[lo - 1]) <= last:
            lo = max(0, lo - k)
        while hi < len(ref) and abs(x - ref[hi]) <= last:
            hi = min(len(ref), hi + k)
        open_[i] = (below and (not len(ref) or abs(x - ref[0]) <= last)) or (above and (not len(ref) or abs(x - ref[-1]) <= last))
        found.append(lo + np.lexsort((turn[lo:hi], np.abs(x - ref[lo:hi])))[:k])
    return found, open_


def in_range(k: int, ends: dict[int, tuple[bool, bool]], r_id: str) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a range of queries finds among the reference rows that were sent to it; a null id asks for a look at all of them."""

    def find(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held, xs = held.sort_values("_r", kind="stable"), asked["_x"].to_numpy(float)
        ids = held[r_id].to_numpy()
        turn = np.unique(ids, return_inverse=True)[1] if len(ids) else np.zeros(0, int)
        found, open_ = nearest(xs, held["_r"].to_numpy(float), turn, k, *ends[key[0]])
        found = [p[:0] if o else p for p, o in zip(found, open_)]
        near = pd.DataFrame({"_x": np.repeat(xs, [len(p) for p in found]), r_id: ids[np.concatenate([np.zeros(0, int), *found])]})
        return pd.concat([near, pd.DataFrame({"_x": xs[open_], r_id: pd.Series([None] * int(open_.sum()), dtype=object)})]) if open_.any() else near

    return find


def nearest_k(queries: DataFrame, ref: DataFrame, q_id: str, q_x: str, r_id: str, r_x: str, k: int, ranges: int = 256) -> DataFrame:
    """(q_id, r_id) of the k reference rows closest to each query as doubles, ties by r_id. A null or NaN is farther than any number.

    Of equal reference values the k first ids can be among the nearest, and
    equal queries find the same, so copies of a value are looked at once.
    Both are cut into ranges by quantiles of all values; a range also gets the
    neighbours that hold at least k rows on each side, sorts them, and a
    query takes k each way from its place, and all that tie with the last. The
    work is a sort and k rows a different query. Where rows outside a range's
    neighbours may still tie by rounding, a query is compared with all.
    """
    spark = ref.sparkSession
    ship(spark)
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = ref.select(r_id, number(r_x).alias("_r"))
    first = F.row_number().over(Window.partitionBy("_r").orderBy(r_id))
    held = cut(rows.withColumn("_n", first).where(F.col("_n") <= k).drop("_n"))
    known, unknown = held.where("_r is not null"), held.where("_r is null")
    queries = queries.select(q_id, number(q_x).alias("_x"))
    n = known.count()
    if n < k:  # all of them, and of those without a number the first ids
        known = known.unionByName(unknown.orderBy(r_id).limit(k - n))
    lost = queries.where("_x is null").select(q_id).crossJoin(F.broadcast(rows.select(r_id).orderBy(r_id).limit(k)))
    if n <= k:
        return queries.where("_x is not null").select(q_id).crossJoin(F.broadcast(known.select(r_id))).unionByName(lost)

    asked = cut(queries.where("_x is not null").select("_x").distinct())
    every = known.select(F.col("_r").alias("_v")).unionByName(asked.select(F.col("_x").alias("_v")))
    parts = max(1, min(ranges, n // (4 * k)))
    edges = np.array(sorted(set(every.agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 10_000)).first()[0])) if parts > 1 else [])

    @F.pandas_udf("int")
    def bucket(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy(float), side="right").astype("int32"))

    dealt = cut(known.withColumn("_b", bucket("_r")))
    sizes = {r["_b"]: r["n"] for r in dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `ranges` rows
    to: dict[int, list[int]] = {b: [] for b in range(len(edges) + 1)}
    ends = {}
    for b in to:
        lo = hi = b
        below = above = 0
        while lo > 0 and below < k:
            lo -= 1
            below += sizes.get(lo, 0)
        while hi < len(edges) and above < k:
            hi += 1
            above += sizes.get(hi, 0)
        for other in range(lo, hi + 1):
            to[other].append(b)
        ends[b] = any(sizes.get(x, 0) for x in range(lo)), any(sizes.get(x, 0) for x in range(hi + 1, len(edges) + 1))
    near = spark.createDataFrame([(b, x) for b, xs in to.items() for x in xs], "_b int, _to int")
    sent = dealt.join(F.broadcast(near), "_b").select(F.col("_to").alias("_b"), "_r", r_id)
    kind = ref.schema[r_id].dataType.simpleString()
    found = asked.withColumn("_b", bucket("_x")).groupBy("_b").cogroup(sent.groupBy("_b")).applyInPandas(in_range(k, ends, r_id), f"_x double, `{r_id}` {kind}")
    found = cut(found)
    left = found.where(F.col(r_id).isNull()).select("_x")
    if not left.isEmpty():
        rank = F.row_number().over(Window.partitionBy("_x").orderBy(F.abs(F.col("_x") - F.col("_r")), r_id))
        whole = left.crossJoin(known).withColumn("_n", rank).where(F.col("_n") <= k).select("_x", r_id)
        found = found.where(F.col(r_id).isNotNull()).unionByName(whole)
    return queries.join(found, "_x").select(q_id, r_id).unionByName(lost)
