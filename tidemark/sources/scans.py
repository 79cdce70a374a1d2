"""Readers with fixed schemas, and table shapes of the sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VINTAGE = "obs_date date, value double, release_date date"


def read_vintage(spark: SparkSession, path: str, series: str) -> DataFrame:
    """CSV of (observation, value, release) with a header; "." is missing; a malformed row is an error."""
    return spark.read.schema(VINTAGE).option("header", True).option("nullValue", ".").option("mode", "FAILFAST").csv(path).withColumn("series_id", F.lit(series))


def merge_vintages(dfs: list[DataFrame], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(distinct rows of all, keys with more than one)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    out = out.distinct()
    return out, out.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unpivot_series(df: DataFrame, day: str, cols: list[str]) -> DataFrame:
    return df.unpivot([day], cols, "series_id", "value").where("value is not null")


def select_variables(df: DataFrame, day: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Two (variable, unit) pairs side by side on days that have both; one aggregation instead of a self-join."""
    pick = lambda v: F.max(F.when((F.col("variable") == v[0]) & (F.col("unit") == v[1]), F.col("value")))
    return df.groupBy(day).agg(pick(a).alias("a"), pick(b).alias("b")).where("a is not null and b is not null")


def panel_long(df: DataFrame, day: str, entities: list[str], scale: float = 1000.0) -> DataFrame:
    """Wide panel to long: values that are not positive are null, weeks without any are dropped, units divided by scale."""
    positive = {e: F.when(F.col(e) > 0, F.col(e) / scale) for e in entities}
    some = df.withColumns(positive).where(F.coalesce(*map(F.col, entities)).isNotNull())
    return some.unpivot([day], entities, "entity", "value")


def release_cells(df: DataFrame, keys: list[str], week: str, available: str, value: str) -> DataFrame:
    """Of several releases of a cell, the earliest available one."""
    return df.groupBy(*keys, week).agg(F.min_by(F.struct(value, available), F.struct(available, value)).alias("_r")).select(*keys, week, "_r.*")


def release_tables(df: DataFrame, cells: dict[str, tuple[str, str]], release: str, week: str, available: str) -> DataFrame:
    """Cells (stub1, stub2, value: text) of many release tables as one row per week: the cells picked by their two labels, from the earliest available release that has all of them.

    Numbers may have thousands separators; a table that lacks a picked cell, or in which it is no number, is left out.
    """
    number = F.expr("try_cast(replace(value, ',', '') AS double)")
    pick = lambda k: F.max(F.when((F.trim("stub1") == k[0]) & (F.trim("stub2") == k[1]), number))
    tables = df.groupBy(release, week, available).agg(*[pick(k).alias(name) for name, k in cells.items()])
    whole = tables.where(" and ".join(f"{name} is not null" for name in cells))
    return whole.groupBy(week).agg(F.min_by(F.struct(available, *cells), F.struct(available, release)).alias("_r")).select(week, "_r.*")


def read_positions(spark: SparkSession, path: str, constants: dict[str, str], unique: str, numbers: list[str]) -> DataFrame:
    """JSON records of text fields: `unique` (a date) and `numbers` (bigint), in which every one of `constants` has its value.

    A malformed line, a text that is no number or negative, a repeated date or another constant is an error.
    """
    from pyspark.errors import PySparkValueError

    fields = [*constants, unique, *numbers]
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in fields)).option("mode", "FAILFAST").json(path)
    bad = lambda c: F.expr(f"try_cast(`{c}` AS bigint)").isNull() | (F.expr(f"try_cast(`{c}` AS bigint)") < 0)
    checks = {**{c: F.count_if(~F.col(c).eqNullSafe(F.lit(v))) for c, v in constants.items()}, **{c: F.count_if(bad(c)) for c in numbers}}
    # one aggregation; a date that comes twice is counted by its own
    wrong = raw.agg(*[v.alias(c) for c, v in checks.items()]).first().asDict() if checks else {}
    wrong[unique] = raw.groupBy(unique).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.expr(f"try_cast(`{unique}` AS date)").isNull()).limit(1).count()
    if any(wrong.values()):
        raise PySparkValueError(f"records break their rules: {', '.join(c for c, n in wrong.items() if n)}")
    return raw.select(F.col(unique).cast("date").alias(unique), *[F.col(c).cast("bigint").alias(c) for c in numbers])


def table_rows(pages: DataFrame, keys: list[str], html: str, group: str, cells: dict[str, str]) -> DataFrame:
    """Rows (keys, pos, group, cells) of the tables of each page, by the class of their td or th: a cell of class `group` heads the rows below it, too.

    cells names columns by class. Tags are stripped; a missing cell is null. A page without rows gives none.
    """
    text = lambda row, kind: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(row, rf"""(?s)<t[dh]\b[^>]*class=["']{kind}["'][^>]*>(.*?)</t[dh]>""", 1), r"<[^>]*>", "")), F.lit(""))
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "_row"))
    named = rows.select(*keys, "pos", text(F.col("_row"), group).alias("group"), *[text(F.col("_row"), kind).alias(c) for c, kind in cells.items()])
    return carry_down(named, keys, "pos", "group")


def list_items(html: Column) -> Column:
    """Texts of the list items of a page."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1)), lambda r: F.trim(F.regexp_replace(r, r"<[^>]*>", "")))


def carry_down(df: DataFrame, keys: list[str], order: str, col: str) -> DataFrame:
    """Null values take the last one above them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(col, ignorenulls=True).over(w))


def feed_items(html: Column, tag: str, cap: int) -> Column:
    """The first `cap` elements of a feed, CDATA unwrapped."""
    found = F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.slice(F.transform(found, lambda x: F.regexp_replace(x, r"<!\[CDATA\[|\]\]>", "")), 1, cap)


RSS = "channel struct<item: array<struct<title: string, link: string, pubDate: string>>>"
SITEMAP = "url array<struct<loc: string, news: struct<title: string, publication_date: string>>>"


def _items(found: Column, title: str, link: str, published: str) -> Column:
    """Items with their fields as plain text; a missing field is an empty one."""
    from ..functions.text import html_to_text

    field = lambda x, name: html_to_text(F.coalesce(reduce(lambda c, n: c[n], name.split("."), x), F.lit("")))
    every = F.transform(found, lambda x: F.struct(field(x, title).alias("title"), field(x, link).alias("link"), field(x, published).alias("published")))
    return F.coalesce(every, F.array().cast("array<struct<title: string, link: string, published: string>>"))


def rss_items(xml: Column, cap: int = 30) -> Column:
    """The first `cap` items of an RSS feed as (title, link, published). The parser takes CDATA and references; markup in a field is stripped. What is no XML has none."""
    parsed = F.from_xml(xml, RSS, {"ignoreNamespace": "true"})
    return F.slice(_items(parsed["channel"]["item"], "title", "link", "pubDate"), 1, cap)


def sitemap_urls(xml: Column, prefix: str, cap: int = 200) -> Column:
    """The first `cap` news items of a sitemap that have a title and whose address begins with `prefix`, as (title, link, published)."""
    parsed = F.from_xml(xml, SITEMAP, {"ignoreNamespace": "true"})
    return F.slice(F.filter(_items(parsed["url"], "news.title", "loc", "news.publication_date"), lambda x: (x["title"] != "") & F.startswith(x["link"], F.lit(prefix))), 1, cap)


def recent_context(df: DataFrame, day: str, cols: list[str], n: int, least: int) -> DataFrame:
    """First and last values of the last n rows in which all cols are present; nothing if fewer than `least`."""
    full = df.where(" and ".join(f"{c} is not null" for c in cols)).orderBy(F.desc(day)).limit(n)
    ends = [f for c in cols for f in (F.min_by(c, day).alias(f"first_{c}"), F.max_by(c, day).alias(f"last_{c}"))]
    return full.agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), *ends).where(F.col("n") >= least)
