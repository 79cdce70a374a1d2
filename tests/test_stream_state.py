"""State across micro-batches and restarts: late rows, first-wins keys, the freshness machine; each against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.evidence import dedup_multi
from tidemark.streaming import streams as st

BASE = dt.datetime(2024, 1, 1)
hours = lambda h: dt.timedelta(hours=h)


def files(spark, tmp_path, batches, schema):
    """Batches as files of a folder; what stands at a place of `batches` may be added later."""
    path = str(tmp_path / "in")

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    for rows in batches:
        add(rows)
    return path, add


def test_late_rows_leave_by_the_side_over_a_restart(spark, tmp_path):
    rng = random.Random(4)
    batches = [[(100 * b + i, None if rng.random() < 0.05 else BASE + hours(40 * b + rng.uniform(-150, 40))) for i in range(40)] for b in range(5)]
    path, add = files(spark, tmp_path, batches[:3], "id int, ts timestamp")
    out = str(tmp_path / "out")
    st.with_freshness(st.read_events(spark, path, 1), 72, out)
    for rows in batches[3:]:
        add(rows)
    st.with_freshness(st.read_events(spark, path, 1), 72, out)  # goes on from its checkpoint
    st.with_freshness(st.read_events(spark, path, 1), 72, out)  # nothing is left to do
    fresh, late = ([r.id for r in spark.read.parquet(f"{out}/{x}").collect()] for x in ("fresh", "excluded"))
    want, seen = [], None
    for rows in batches:
        want += [i for i, ts in rows if ts is None or seen is not None and ts < seen - hours(72)]
        seen = max([t for _, t in rows if t] + ([seen] if seen else []))
    assert sorted(late) == sorted(want) and len(want) > 20
    assert sorted(fresh + late) == sorted(i for rows in batches for i, _ in rows)


def test_a_repeated_batch_overwrites_its_part(spark, tmp_path):
    """A failure after the batch's rows are written, before the batch is committed: it runs again."""
    path, _ = files(spark, tmp_path, [[(1, BASE)], [(2, BASE - hours(100)), (3, BASE)]], "id int, ts timestamp")
    out, runs = str(tmp_path / "out"), []

    class Failing(Exception):
        pass

    original = st.run_batches

    def failing(stream, each, at):
        def once(df, i, p):
            each(df, i, p)
            runs.append(i)
            if runs == [0, 1]:
                raise Failing

        return original(stream, once, at)

    st.run_batches = failing
    try:
        with pytest.raises(Exception):
            st.with_freshness(st.read_events(spark, path, 1), 72, out)
        st.with_freshness(st.read_events(spark, path, 1), 72, out)
    finally:
        st.run_batches = original
    assert runs == [0, 1, 1]
    assert [r.id for r in spark.read.parquet(f"{out}/excluded").collect()] == [2]
    assert sorted(r.id for r in spark.read.parquet(f"{out}/fresh").collect()) == [1, 3]


def test_first_wins_over_several_keys_equals_the_batch_operator(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "BATCHES_PER_SNAPSHOT", 2)
    rng = random.Random(6)
    key = lambda n: None if rng.random() < 0.1 else f"k{rng.randrange(n)}"
    rows = [(i, BASE + hours(i), key(30), key(40), key(25)) for i in range(120)]
    path, add = files(spark, tmp_path, [rows[:30], rows[30:70]], "id int, ts timestamp, a string, b string, c string")
    out, keys = str(tmp_path / "out"), ["a", "b", "c"]
    st.dedup_first_wins(st.read_events(spark, path, 1), keys, ["ts", "id"], "id", 10_000, out)
    add(rows[70:])
    st.dedup_first_wins(st.read_events(spark, path, 1), keys, ["ts", "id"], "id", 10_000, out)
    accepted = sorted(r.id for r in spark.read.parquet(f"{out}/accepted").collect())
    whole = spark.createDataFrame(rows, "id int, ts timestamp, a string, b string, c string")
    assert accepted == sorted(r.id for r in dedup_multi(whole, keys, ["ts", "id"], "id").collect())
    seen, fold = set(), []
    for i, _, *ks in rows:
        own = {(n, k) for n, k in enumerate(ks) if k}
        if not own & seen:
            fold.append(i)
            seen |= own
    assert accepted == fold
    assert sorted(accepted + [r.id for r in spark.read.parquet(f"{out}/excluded").collect()]) == list(range(120))


@pytest.mark.parametrize("snapshot", [1, 20])
def test_first_wins_forgets_old_keys(spark, tmp_path, monkeypatch, snapshot):
    monkeypatch.setattr(st, "BATCHES_PER_SNAPSHOT", snapshot)
    rows = [(1, BASE, "x"), (2, BASE + hours(50), "y"), (3, BASE + hours(60), "x"), (4, BASE + hours(61), "y")]
    path, _ = files(spark, tmp_path, [[r] for r in rows], "id int, ts timestamp, a string")
    out = st.dedup_first_wins(st.read_events(spark, path, 1), ["a"], ["ts", "id"], "id", 24)
    assert sorted(r.id for r in spark.read.parquet(f"{out}/accepted").collect()) == [1, 2, 3]


def machine_loop(events, end, span):
    out = []
    for k in sorted({e[0] for e in events}):
        at = held = None
        live = False
        for _, t, x, ok in sorted(e for e in events if e[0] == k):
            if live and at + span < t:
                out.append((k, at + span, "STALE", held, "EXPIRED"))
                live = False
            if not ok:
                out.append((k, t, "LIVE" if live else "UNAVAILABLE" if at is None else "STALE", held, "HASH_MISMATCH"))
                continue
            if not live:
                out.append((k, t, "LIVE", x, None))
            at, held, live = t, x, True
        if live and at + span < end:
            out.append((k, at + span, "STALE", held, "EXPIRED"))
    return out


def test_freshness_machine_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(8)
    events = sorted(((k, BASE + hours(round(rng.uniform(0, 400), 2)), float(i), rng.random() > 0.3) for i, k in enumerate(rng.choice([1, 2, 3, 4]) for _ in range(60))), key=lambda e: e[1])
    events += [(5, events[-1][1] + hours(1), 1.0, False), (5, events[-1][1] + hours(2), 2.0, True)]
    cut = [events[:15], events[15:30], events[30:45], events[45:]]
    path, add = files(spark, tmp_path, cut[:2], "k bigint, ts timestamp, value double, ok boolean")
    out = str(tmp_path / "out")
    run = lambda: st.run_available(st.freshness_machine(st.read_events(spark, path, 1), "k", "value", 24, "1 hour", F.col("ok")), path=out)
    run()
    for rows in cut[2:]:
        add(rows)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = sorted((tuple(r) for r in run().collect()), key=str)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    want = sorted(machine_loop(events, max(e[1] for e in events) - hours(1), hours(24)), key=str)
    assert got == want
    assert {x[2] for x in got} == {"LIVE", "STALE", "UNAVAILABLE"}
