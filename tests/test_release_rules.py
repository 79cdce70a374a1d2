"""Guards, expiry by rule, three-way reconciliation, feeds, and counts beside a write: boundaries, nulls and what does not parse."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence as ev
from tidemark.operators import quality as q
from tidemark.sources import scans

NOW = dt.datetime(2024, 1, 10, 12)


def test_guards_by_word_and_weekday(spark):
    wednesday = dt.date(2024, 1, 10)
    rows = [
        ("Exports were halted on Monday.", wednesday, ""), ("Exports were halted on Sunday.", wednesday, "OLD_WEEKDAY"), ("It closed on wednesday.", wednesday, ""), ("It closed ON Thursday.", wednesday, "OLD_WEEKDAY"),
        ("It may close on Monday, analysts say.", wednesday, "CONDITIONAL,COMMENTARY"), ("It has not closed.", wednesday, "NEGATED"), ("It closed last week, and on March 3.", wednesday, "HISTORICAL"), ("It closed 3 days ago", wednesday, "HISTORICAL"),
        ("Mayhem in Notting Hill, in 1999.", wednesday, ""), ("on Sunday", None, ""), ("if", None, "CONDITIONAL"), (None, wednesday, ""), ("", wednesday, ""),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d date, want string")
    for r in df.select("*", F.array_join(ev.guards(F.col("t"), F.col("d")), ",").alias("got")).collect():
        assert (r.got or "") == r.want, r
    assert [r[0] for r in spark.createDataFrame([("it might",), ("it did",)], "t string").select(ev.guarded(F.col("t"))).collect()] == [True, False]


FIELDS = "id int, category string, made_at timestamp_ntz, event_date date, released_on date, market_date date, effective_until date, policy_checked_at timestamp_ntz, latest_release date, observed_week date, next_release_at timestamp_ntz, inventory_checked_at timestamp_ntz, china_checked_at timestamp_ntz"


def signal(i, category, **own):
    day = dt.date(2024, 1, 9)
    base = dict(made_at=NOW - dt.timedelta(hours=2), event_date=day, released_on=day, market_date=day, effective_until=dt.date(2024, 2, 1), policy_checked_at=NOW, latest_release=day, observed_week=day, next_release_at=dt.datetime(2024, 1, 16, 15), inventory_checked_at=NOW, china_checked_at=NOW - dt.timedelta(hours=3)) | own
    return (i, category, *(base[f.split()[0]] for f in FIELDS.split(", ")[2:]))


def test_expiry_by_rule(spark):
    ago = lambda **x: NOW - dt.timedelta(**x)
    day = lambda n: dt.date(2024, 1, n)
    cases = [
        (signal(1, "MARKET"), dt.datetime(2024, 1, 11, 10)), (signal(2, "MARKET", market_date=day(8)), None), (signal(3, "MARKET", made_at=ago(days=1)), None),
        (signal(4, "SUPPLY"), dt.datetime(2024, 1, 12)), (signal(5, "SUPPLY", event_date=day(7)), None), (signal(6, "SUPPLY", event_date=day(11)), None), (signal(7, "MACRO"), dt.datetime(2024, 1, 16)),
        (signal(8, "OPEC_POLICY"), dt.datetime(2024, 2, 1)), (signal(9, "OPEC_POLICY", policy_checked_at=ago(days=1)), None), (signal(10, "OPEC_POLICY", effective_until=None), None), (signal(11, "OPEC_POLICY", policy_checked_at=NOW + dt.timedelta(seconds=1)), None),
        (signal(12, "INVENTORY"), dt.datetime(2024, 1, 16, 15)), (signal(13, "INVENTORY", released_on=day(2)), None), (signal(14, "INVENTORY", observed_week=day(3)), None), (signal(15, "INVENTORY", released_on=None), None),
        (signal(16, "CHINA_ADJUSTMENT"), dt.datetime(2024, 1, 11, 9)), (signal(17, "CHINA_ADJUSTMENT", china_checked_at=None), None), (signal(18, "OTHER"), None), (signal(19, None), None),
    ]
    df = spark.createDataFrame([c for c, _ in cases], FIELDS)
    got = {r.id: r.e for r in df.select("id", ev.expiry_by_rule(F.lit(NOW).cast("timestamp_ntz")).alias("e")).collect()}
    assert got == {c[0]: want for c, want in cases}


def test_three_sources_of_a_release(spark):
    period, release = dt.date(2024, 1, 5), dt.date(2024, 1, 10)
    right = "For the week ending January 5, 2024, stocks increased 1.2 thousand."
    page = "<a href=/archive/2024/2024_01_10/report>"

    def row(i, authority=(101234, 100000), table=(101.234, 100.0), summary=right, landing=page, measure="stocks", checked=dt.date(2024, 1, 11)):
        return (i, period, measure, measure == "stocks", *authority, *table, summary, landing, release, dt.date(2024, 1, 3), checked, dt.date(2024, 1, 17))

    ok = ["SUMMARY_CONFIRMS_CURRENT_RELEASE", "LANDING_CONFIRMS_CURRENT_RELEASE"]
    cases = [
        (row(1), "OK", ok), (row(2, authority=(None, 100000)), "AUTHORITY_WEEK_MISSING", ok), (row(3, authority=(101235, 100000)), "AUTHORITY_VALUE_CONFLICT", ok), (row(4, authority=(0, 100000)), "AUTHORITY_WEEK_MISSING", ok),
        (row(5, summary=None, landing=None), "OK", ["SUMMARY_UNAVAILABLE", "LANDING_UNAVAILABLE"]), (row(6, summary=right.replace("January 5, 2024", "December 29, 2023")), "OK", ["SUMMARY_LAGGING_CURRENT_RELEASE", "LANDING_CONFIRMS_CURRENT_RELEASE", "SOURCE_PROPAGATION_LAG"]),
        (row(7, summary=right.replace("January 5", "January 4")), "SECONDARY_DATE_CONFLICT", ["LANDING_CONFIRMS_CURRENT_RELEASE"]), (row(8, summary="Stocks rose.", landing="<html>"), "OK", ["SUMMARY_DATE_UNPARSED", "LANDING_DATE_UNPARSED"]),
        (row(9, summary=right.replace("1.2", "1.3")), "SECONDARY_VALUE_CONFLICT", ok), (row(10, summary=right.replace("increased", "decreased")), "SECONDARY_VALUE_CONFLICT", ok), (row(11, summary="For the week ending January 5, 2024, nothing."), "OK", ["SUMMARY_PARTIAL_CONFIRMATION", "LANDING_CONFIRMS_CURRENT_RELEASE"]),
        (row(12, landing=page.replace("01_10", "01_03"), checked=dt.date(2024, 1, 17)), "OK", ["SUMMARY_CONFIRMS_CURRENT_RELEASE", "LANDING_LAGGING_CURRENT_RELEASE", "SOURCE_PROPAGATION_LAG", "AWAITING_NEW_MACHINE_RELEASE"]), (row(13, landing=page.replace("01_10", "01_09")), "SECONDARY_DATE_CONFLICT", ["SUMMARY_CONFIRMS_CURRENT_RELEASE"]),
        (row(14, measure="inputs", authority=(None, None)), "OK", ["SUMMARY_PARTIAL_CONFIRMATION", "LANDING_CONFIRMS_CURRENT_RELEASE"]), (row(15, summary="Week ending Smarch 41, 2024"), "OK", ["SUMMARY_DATE_UNPARSED", "LANDING_CONFIRMS_CURRENT_RELEASE"]),
    ]
    schema = "id int, period date, measure string, has_authority boolean, authority_current bigint, authority_previous bigint, table_current double, table_previous double, summary string, landing string, release_date date, prior_release_date date, checked_at date, next_release_at date"
    for r, code, diagnostics in cases:
        (got,) = ev.reconcile_release(spark.createDataFrame([r], schema), {"stocks": (r"(?i)stocks (increased|decreased) ([\d.]+) thousand", "change")}).collect()
        assert (got.code, got.diagnostics, got.change) == (code, diagnostics, 1.234), r


def test_feeds_and_sitemaps(spark):
    rss = "<?xml version='1.0'?><rss><channel><title>Feed</title><item><title><![CDATA[A &amp; <b>B</b>]]></title><link>https://e.org/?a=1&amp;b=2</link><pubDate>Mon</pubDate></item><item><link>x</link></item></channel></rss>"
    many = "<rss><channel>" + "".join(f"<item><title>t{i}</title></item>" for i in range(40)) + "</channel></rss>"
    df = spark.createDataFrame([(1, rss), (2, many), (3, None), (4, "no xml <at all"), (5, "<rss><channel></channel></rss>"), (6, "")], "i int, x string")
    got = {r.i: [tuple(x) for x in r.t] for r in df.select("i", scans.rss_items(F.col("x")).alias("t")).collect()}
    assert got[1] == [("A & B", "https://e.org/?a=1&b=2", "Mon"), ("", "x", "")]
    assert [x[0] for x in got[2]] == [f"t{i}" for i in range(30)] and got[3] == got[4] == got[5] == got[6] == []
    url = lambda loc, title: f"<url><loc>{loc}</loc><news:news><news:title>{title}</news:title><news:publication_date>2024</news:publication_date></news:news></url>"
    sitemap = '<urlset xmlns:news="n">' + url("https://e.org/1", "One") + url("https://f.org/2", "Two") + url("https://e.org/3", "") + "".join(url(f"https://e.org/{i}", i) for i in range(300)) + "</urlset>"
    (r,) = spark.createDataFrame([(sitemap,)], "x string").select(scans.sitemap_urls(F.col("x"), "https://e.org/").alias("t")).collect()
    assert len(r.t) == 200 and tuple(r.t[0]) == ("One", "https://e.org/1", "2024") and r.t[1].title == "0"


def test_counts_of_the_scan_that_writes(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def look(x):
        seen.add(1)
        return x

    df = spark.range(10).select(look(F.col("id").cast("int")).alias("v"))
    checks = {"small": F.col("v") < 3, "none": F.col("v") < 0}
    got = {r.check: r.violations for r in q.write_counted(df, str(tmp_path / "a"), checks).collect()}
    assert got == {"small": 3, "none": 0} and seen.value == 10  # one scan
    with pytest.raises(ValueError, match="small: 3"):
        q.write_asserted(df, str(tmp_path / "b"), checks)
    assert q.write_asserted(df, str(tmp_path / "c"), {"none": checks["none"]}).count() == 10
