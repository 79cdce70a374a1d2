"""Named queries over the driver's tables, each with SQL that states the same result independently."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Views in SQL, in order of dependence. `Tables` has the same ones as DataFrames.
VIEWS = {
    "v_vintage": "SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date, CAST(l_shipdate AS DATE) AS release_date, l_extendedprice AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "v_pit": "SELECT series_id, obs_date, release_date, max(value) AS value, release_date + 1 AS available_at FROM v_vintage WHERE release_date >= obs_date AND value > 0 GROUP BY ALL",
    "v_daily": "SELECT series_id, obs_date, avg(value) AS value, max(available_at) AS available_at FROM v_pit GROUP BY ALL",
    "v_weekly": "SELECT series_id, CAST(date_trunc('week', obs_date) AS DATE) AS week, avg(value) AS value, count(*) AS n, max(available_at) AS available_at FROM v_daily GROUP BY ALL",
    "v_spine": "SELECT DISTINCT series_id, CAST(date_trunc('month', obs_date) AS DATE) AS day FROM v_pit",
    "v_panel": "SELECT n_name AS entity, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "v_two": "SELECT CAST(o_orderdate AS DATE) AS obs_date, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS a, avg(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS b FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL",
    "v_two_weekly": "SELECT CAST(date_trunc('week', obs_date) AS DATE) AS week, avg(a) AS a, avg(b) AS b FROM v_two WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL",
    "v_positions": "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS long_qty, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS short_qty, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS spread_qty, CAST(sum(l_quantity) AS BIGINT) AS open_interest FROM lineitem GROUP BY ALL",
    "v_long": "SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS variable, l_linestatus AS unit, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL",
    "v_cycles": "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS cycle_date FROM orders",
    "v_probs": "SELECT o_orderkey AS row_id, CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderdate AS DATE) AS day, m.model, w.d / (w.d + w.f + w.u) AS p_down, w.f / (w.d + w.f + w.u) AS p_flat, w.u / (w.d + w.f + w.u) AS p_up, CASE o_orderstatus WHEN 'F' THEN 'DOWN' WHEN 'O' THEN 'FLAT' ELSE 'UP' END AS truth FROM orders, (VALUES ('m1', 7, 5, 3), ('m2', 3, 4, 8)) AS m(model, x, y, z), LATERAL (SELECT CAST(1 + o_orderkey % m.x AS DOUBLE) AS d, CAST(1 + o_custkey % m.y AS DOUBLE) AS f, CAST(1 + (o_orderkey + o_custkey) % m.z AS DOUBLE) AS u) AS w",
    "v_binary": "SELECT d.doc_id, 1 / (1 + exp(-(n_chars - 1000) / 1000.0)) AS p, quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL",
    "v_signals": "SELECT event_id AS id, 'src' || CAST(user_id % 7 AS VARCHAR) AS source, event_type AS category, event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS event_key, 'k' || CAST(user_id % 5 AS VARCHAR) AS measurement_key, CASE WHEN value > 12 THEN 'UP' WHEN value < 4 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction, CAST(1 + event_id % 3 AS INT) AS importance, CAST(ts AS TIMESTAMP) AS published_at, CAST(ts AS DATE) AS event_date, value, user_id, event_id % 4 = 0 AS structured FROM events",
}
BASES = {name: re.findall(r"\bv_\w+", sql) for name, sql in VIEWS.items()}


def with_views(sql: str) -> str:
    """sql with the views that it names put before it."""
    need: list[str] = []

    def visit(name: str) -> None:
        for x in BASES[name]:
            visit(x)
        if name not in need:
            need.append(name)

    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS:
            visit(name)
    if not need:
        return sql
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if m := re.match(r"WITH( RECURSIVE)?\s", body, re.I):
        return f"WITH{m[1] or ''} {views}, {body[m.end():]}"
    return f"WITH {views} {body}"


class Tables:
    """The driver's tables and the domain views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def vintage(self) -> DataFrame:
        rows = self["orders"].join(self["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
        return rows.select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("obs_date"), F.to_date("l_shipdate").alias("release_date"), F.col("l_extendedprice").alias("value"))

    @cached_property
    def pit(self) -> DataFrame:
        good = self.vintage.where("release_date >= obs_date and value > 0")
        return good.groupBy("series_id", "obs_date", "release_date").agg(F.max("value").alias("value")).withColumn("available_at", F.date_add("release_date", 1))

    @cached_property
    def daily(self) -> DataFrame:
        return self.pit.groupBy("series_id", "obs_date").agg(F.avg("value").alias("value"), F.max("available_at").alias("available_at"))

    @cached_property
    def written(self) -> Tables:
        """These tables with `daily` written, which `weekly` and `spine` follow from: for plans that read them more than once, which would join the vintages each time and may find means that differ in their last bit."""
        out = Tables(self.spark, self.sf_dir)
        out.daily, out.written = cut(self.daily), out
        return out

    @cached_property
    def weekly(self) -> DataFrame:
        return self.daily.groupBy("series_id", week_start("obs_date").alias("week")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"), F.max("available_at").alias("available_at"))

    @cached_property
    def spine(self) -> DataFrame:
        return self.daily.select("series_id", F.trunc("obs_date", "month").alias("day")).distinct()

    @cached_property
    def panel(self) -> DataFrame:
        rows = self["orders"].join(self["customer"], F.col("o_custkey") == F.col("c_custkey")).join(self["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.groupBy(F.col("n_name").alias("entity"), week_start("o_orderdate").alias("week")).agg(F.avg("o_totalprice").alias("value"))

    @cached_property
    def two(self) -> DataFrame:
        one = lambda p: F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
        return self["orders"].where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).groupBy(F.to_date("o_orderdate").alias("obs_date")).agg(one("1-URGENT").alias("a"), one("5-LOW").alias("b"))

    @cached_property
    def two_weekly(self) -> DataFrame:
        return self.two.where("a is not null and b is not null").groupBy(week_start("obs_date").alias("week")).agg(F.avg("a").alias("a"), F.avg("b").alias("b"))

    @cached_property
    def positions(self) -> DataFrame:
        of = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0)).cast("bigint")
        return self["lineitem"].groupBy(week_start("l_shipdate").alias("week")).agg(of("A").alias("long_qty"), of("R").alias("short_qty"), of("N").alias("spread_qty"), F.sum("l_quantity").cast("bigint").alias("open_interest"))

    @cached_property
    def long(self) -> DataFrame:
        return self["lineitem"].groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("variable"), F.col("l_linestatus").alias("unit")).agg(F.avg("l_extendedprice").alias("value"))

    @cached_property
    def cycles(self) -> DataFrame:
        return self["orders"].select(F.trunc(F.to_date("o_orderdate"), "month").alias("cycle_date")).distinct()

    @cached_property
    def probs(self) -> DataFrame:
        model = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), *[F.lit(v).alias(k) for k, v in zip("xyz", w)]) for n, w in (("m1", (7, 5, 3)), ("m2", (3, 4, 8)))])).alias("m")
        rows = self["orders"].select("*", model)
        d, f, u = ((1 + e % F.col(f"m.{k}")).cast("double") for e, k in ((F.col("o_orderkey"), "x"), (F.col("o_custkey"), "y"), (F.col("o_orderkey") + F.col("o_custkey"), "z")))
        truth = F.when(F.col("o_orderstatus") == "F", "DOWN").when(F.col("o_orderstatus") == "O", "FLAT").otherwise("UP")
        return rows.select(F.col("o_orderkey").alias("row_id"), F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("day"), "m.model", (d / (d + f + u)).alias("p_down"), (f / (d + f + u)).alias("p_flat"), (u / (d + f + u)).alias("p_up"), truth.alias("truth"))

    @cached_property
    def binary(self) -> DataFrame:
        rows = self["documents"].join(self["labels"].where("quality is not null"), "doc_id")
        return rows.select("doc_id", (1 / (1 + F.exp(-(F.col("n_chars") - 1000) / 1000.0))).alias("p"), F.col("quality").alias("y"))

    @cached_property
    def signals(self) -> DataFrame:
        e, user = self["events"], F.col("user_id")
        return e.select(
            F.col("event_id").alias("id"), F.concat(F.lit("src"), (user % 7).cast("string")).alias("source"), F.col("event_type").alias("category"),
            F.concat_ws("-", "event_type", (user % 20).cast("string")).alias("event_key"), F.concat(F.lit("k"), (user % 5).cast("string")).alias("measurement_key"),
            F.when(F.col("value") > 12, "UP").when(F.col("value") < 4, "DOWN").otherwise("NEUTRAL").alias("direction"), (1 + F.col("event_id") % 3).cast("int").alias("importance"),
            F.col("ts").cast("timestamp_ntz").alias("published_at"), F.to_date("ts").alias("event_date"), "value", "user_id", (F.col("event_id") % 4 == 0).alias("structured"),
        )


def week_start(day: str):
    """Monday of the week as a date."""
    return F.to_date(F.date_trunc("week", F.col(day)))


def query(name: str, sql: str | None = None):
    """Register a function of Tables under name, with its SQL unless SQL cannot express it."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


def by(*keys: str, order: str | list = "week") -> Window:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))
