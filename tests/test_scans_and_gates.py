"""Release tables, position records, table rows, documents, gates and packages on tiny frames, and the freshness machine against a loop."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import evidence as ev
from tidemark.operators.windows import expanding_percentile
from tidemark.sources import scans
from tidemark.streaming import streams as st


def day(n):
    return dt.date(2024, 1, n)


def test_release_tables_take_the_earliest_whole_table(spark):
    cell = lambda r, w, a, **v: [(r, day(w), day(a), *k, x) for k, x in (((" Stocks", "Oil"), v["s"]), (("Inputs", "Crude "), v["i"])) if x is not None]
    rows = cell("b", 8, 12, s="1,200.5", i="7") + cell("a", 8, 11, s="1,100", i=None) + cell("c", 8, 13, s="9", i="9") + cell("d", 15, 20, s="n/a", i="1") + cell("e", 15, 21, s="3", i="4")
    df = spark.createDataFrame(rows, "release string, week date, available_at date, stub1 string, stub2 string, value string")
    got = scans.release_tables(df, {"stock": ("Stocks", "Oil"), "inputs": ("Inputs", "Crude")}, "release", "week", "available_at")
    assert sorted(map(tuple, got.collect())) == [(day(8), day(12), 1200.5, 7.0), (day(15), day(21), 3.0, 4.0)]
    assert scans.release_tables(df.limit(0), {"stock": ("Stocks", "Oil")}, "release", "week", "available_at").count() == 0


@pytest.mark.parametrize("bad", [None, {"code": "x"}, {"week": "2024-01-01"}, {"week": "soon"}, {"long": "-1"}, {"long": "1.5x"}, {"long": None}])
def test_positions_check_constants_dates_and_numbers(spark, tmp_path, bad):
    rows = [{"code": "1", "week": f"2024-01-0{i}", "long": str(i)} for i in (1, 2)]
    if bad:
        rows[1] |= bad
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, rows)))
    read = lambda: scans.read_positions(spark, str(tmp_path / "p.json"), {"code": "1"}, "week", ["long"]).collect()
    if bad:
        with pytest.raises(PySparkException):
            read()
    else:
        assert sorted(map(tuple, read())) == [(day(1), 1), (day(2), 2)]


def test_table_rows_carry_the_group_down(spark):
    html = '<table><tr><th>x</th></tr><tr class=r><td class="s1" rowspan=2><b>Crude</b> Oil</td><td class="s2">Brent</td><td class="d1">80.1</td></tr>\n<tr><td class="s2">WTI</td><td class="d1"> </td></tr><tr><td class="s1">Diesel</td><td class="s2">NY</td></tr></table>'
    got = scans.table_rows(spark.createDataFrame([(1, html), (2, None), (3, "none")], "id int, html string"), ["id"], "html", "s1", {"area": "s2", "price": "d1"})
    want = [(1, 0, None, None, None), (1, 1, "Crude Oil", "Brent", "80.1"), (1, 2, "Crude Oil", "WTI", None), (1, 3, "Diesel", "NY", None)]
    assert sorted(map(tuple, got.collect())) == want


def test_documents_give_the_first_reason(spark):
    at = dt.datetime(2024, 1, 6)
    body = "<article><p>Oil rose and this paragraph has more than fifty-five characters in it.</p><p>" + "x" * 30 + "</p></article>"
    rows = [(1, "u/1234", body, at - dt.timedelta(hours=72)), (2, "u/x", body, at), (3, "u/1234", body, at - dt.timedelta(hours=72, seconds=1)), (4, "u/1234", body, at + dt.timedelta(seconds=1)), (5, "u/1234", body, None), (6, "u/1234", "<p>no article</p>", at), (7, "u/1234", body.replace("Oil", "Tea"), at), (8, None, None, None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, published_at timestamp_ntz").withColumn("fetched_at", F.lit(at).cast("timestamp_ntz"))
    got = {r.page_id: r for r in ev.build_documents(df, "page_id", "(?i)oil").collect()}
    late = "ARTICLE_PUBLICATION_TIME_UNVERIFIED"
    assert {i: r.reject for i, r in got.items()} == {1: None, 2: "UNSUPPORTED_ARTICLE_URL", 3: late, 4: late, 5: late, 6: "ARTICLE_BODY_NOT_READ", 7: "UNRELATED_ARTICLE", 8: "UNSUPPORTED_ARTICLE_URL"}
    assert got[1].document_id == "doc-1234" and len(got[1].segments) == 1 and got[1].segments[0].id.startswith("s1-") and len(got[1].segments[0].id) == 15


def test_packages_at_their_bounds(spark):
    now = dt.datetime(2024, 1, 6)
    hours = lambda h: now - dt.timedelta(hours=h)
    rows = [("ok", hours(23), "a", False, False), ("ok", hours(95), "b", True, False), ("age", hours(24), "a", False, True), ("future", hours(-1), "a", False, True), ("old", hours(1), "a", False, False), ("old", hours(73.001), "b", False, False), ("twice", hours(1), "a", False, False), ("twice", hours(1), "a", False, False), ("claim", hours(1), "a", True, True)]
    rows += [("many", hours(1), f"e{i}", False, False) for i in range(7)]
    df = spark.createDataFrame(rows, "package string, at timestamp_ntz, event string, unconfirmed boolean, more boolean")
    got = ev.admit_packages(df, ["package"], "at", "event", F.col("unconfirmed"), F.col("more"), F.lit(now).cast("timestamp_ntz")).collect()
    assert dict(map(tuple, got)) == {"ok": "", "age": "PACKAGE_STALE", "future": "PACKAGE_FUTURE", "old": "SIGNAL_STALE", "twice": "DUPLICATE_EVENT", "claim": "CONFIRMATION", "many": "COUNT"}


def test_signals_are_deduplicated_by_their_first(spark):
    rows = [(3, "k", 2), (1, "k", 5), (2, "k", 2), (9, "m", 1), (8, None, 1)]
    got = ev.dedup_signals(spark.createDataFrame(rows, "id int, key string, at int"), ["key"], [F.col("at"), F.col("id")], "id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("k", 2, 2), ("m", 9, 0), (None, 8, 0)], key=str)


def test_expanding_percentile_against_a_loop(spark):
    rows = [(k, day(1 + i), x) for k in "ab" for i, x in enumerate([3.0, 1.0, None, 3.0, 2.0, 9.0])]
    df = spark.createDataFrame(rows, "k string, at date, v double")
    for strict in (True, False):
        for r in expanding_percentile(df, ["k"], "at", "v", strict).collect():
            old = [x for k, a, x in rows if k == r.k and a < r["at"] and x is not None]
            below = [x for x in old if r.v is not None and (x < r.v or not strict and x == r.v)]
            assert r.earlier == len(old) and r.percentile == (len(below) / len(old) if old else None)


def test_freshness_machine_equals_a_loop(spark, tmp_path):
    base, hours = dt.datetime(2024, 1, 1), 24
    events = [(k, base + dt.timedelta(hours=h), float(h)) for k, hs in {1: [0, 5, 23, 60, 61, 200], 2: [3], 3: [0, 24, 48.5, 90]}.items() for h in hs]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(events, "user_id bigint, ts timestamp, value double").coalesce(1).write.parquet(path)
    got = st.run_available(st.freshness_machine(st.read_events(spark, path), "user_id", "value", hours, "1 hour")).collect()
    want = []
    for k in (1, 2, 3):
        last = held = None
        for _, at, x in sorted(e for e in events if e[0] == k):
            if last is None or at - last > dt.timedelta(hours=hours):
                if last is not None:
                    want.append((k, last + dt.timedelta(hours=hours), "STALE", held))
                want.append((k, at, "LIVE", x))
            last, held = at, x
        end = max(e[1] for e in events) - dt.timedelta(hours=1)  # the watermark at the end
        if last + dt.timedelta(hours=hours) <= end:
            want.append((k, last + dt.timedelta(hours=hours), "STALE", held))
    assert sorted(map(tuple, got)) == sorted(want)
