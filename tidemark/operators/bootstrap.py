"""Bootstraps of block sums. Rows are first summed by block; blocks are stretches of the calendar or cycles in it, so neither they nor the draws grow with the rows.

The generator is one linear congruence of (draw, place), which SQL can state, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranks import SMALL_GROUPS, distribution, sent

#: Fixed values of the generator.
A, B, C, M = 1103515245, 12345, 2654435761, 2147483648


def pick(draw: Column, place: Column, n: Column) -> Column:
    """A number from 0 to n - 1 for each draw and place."""
    x = (draw * C + place * A + B) % M
    return ((x * A + B) % M / F.lit(65536.0)).cast("bigint") % n


def _numbered(blocks: DataFrame, order: str) -> DataFrame:
    """Blocks with their number in order, from 0: few in one window, more by ranges. To be broadcast if they are few."""
    blocks = cut(blocks)
    if (n := blocks.count()) <= SMALL_GROUPS:
        return sent(blocks.withColumn("_i", (F.row_number().over(Window.orderBy(order)) - 1).cast("bigint")), n)
    places = distribution(blocks, [], order).select(F.col(order).alias("_o"), F.col("before").alias("_i"))
    return blocks.join(places, F.col(order) == F.col("_o")).drop("_o")


def _draws(blocks: DataFrame, draws: int, places: Column) -> DataFrame:
    spark = blocks.sparkSession
    n = blocks.agg(F.count(F.lit(1)).alias("_n"))
    return spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n)).withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), places)))


def _interval(stats: DataFrame, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return stats.agg(F.count(F.lit(1)).alias("draws"), q.alias("_q")).select("draws", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("middle"), F.col("_q")[2].alias("high"))


def cluster(blocks: DataFrame, order: str, total: str, n: str, draws: int) -> DataFrame:
    """Interval of sum(total) / sum(n) over clusters drawn with replacement, as many as there are."""
    numbered = _numbered(blocks, order)
    drawn = _draws(blocks, draws, F.col("_n") - 1).withColumn("_i", pick(F.col("draw"), F.col("place"), F.col("_n")))
    stats = drawn.join(numbered, "_i").groupBy("draw").agg((F.sum(total) / F.sum(n)).alias("s"))
    return _interval(stats, "s")


def moving(blocks: DataFrame, order: str, value: str, width: int, draws: int, circular: bool = False) -> DataFrame:
    """Interval of the mean over weeks drawn in runs of `width`; runs wrap around if circular. Null weeks stay in their place and do not count."""
    numbered = _numbered(blocks, order)
    starts = _draws(blocks, draws, F.floor((F.col("_n") + width - 1) / width) - 1)
    range_n = F.col("_n") if circular else F.greatest(F.col("_n") - width + 1, F.lit(1))
    runs = starts.withColumn("_s", pick(F.col("draw"), F.col("place"), range_n)).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    place = F.col("place") * width + F.col("_o")
    kept = runs.where(place < F.col("_n")).withColumn("_i", F.pmod(F.col("_s") + F.col("_o"), F.col("_n")))
    stats = kept.join(numbered, "_i").groupBy("draw").agg(F.avg(value).alias("s"))
    return _interval(stats, "s")
