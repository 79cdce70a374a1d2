"""Exclusive commits: writers in threads, repeated keys, and readers while a version is being written."""

import threading

import pytest

from tidemark.sources import stores


def test_of_two_writers_of_a_key_one_wins(spark, tmp_path):
    path, won, lost = str(tmp_path / "snap"), [], []
    gate = threading.Barrier(4)

    def write(n):
        rows = spark.createDataFrame([(7, f"w{n}"), (100 + n, f"own{n}")], "k int, v string")
        gate.wait()
        try:
            stores.append_snapshot(rows, path, ["k"])
            won.append(n)
        except ValueError:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 3
    assert sorted(tuple(r) for r in stores.read_snapshots(spark, path).collect()) == [(7, f"w{won[0]}"), (100 + won[0], f"own{won[0]}")]


def test_writers_of_different_keys_all_commit(spark, tmp_path):
    path = str(tmp_path / "snap")
    threads = [threading.Thread(target=lambda n=n: stores.append_snapshot(spark.createDataFrame([(n,)], "k int"), path, ["k"])) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.k for r in stores.read_snapshots(spark, path).collect()) == [0, 1, 2, 3]
    assert len(stores.Log(spark, path).entries()) == 4


def test_a_repeated_or_null_key_is_seen(spark, tmp_path):
    path = str(tmp_path / "snap")
    with pytest.raises(ValueError, match="repeats"):
        stores.append_snapshot(spark.createDataFrame([(1,), (1,)], "k int"), path, ["k"])
    stores.append_snapshot(spark.createDataFrame([(None,), (2,)], "k int"), path, ["k"])
    with pytest.raises(ValueError, match="exists"):
        stores.append_snapshot(spark.createDataFrame([(None,)], "k int"), path, ["k"])
    assert stores.read_snapshots(spark, path).count() == 2


def test_readers_see_only_what_is_committed(spark, tmp_path):
    path = str(tmp_path / "cur")
    assert stores.current_version(spark, path) is None and stores.publish_current(spark.range(1), path, False) is None
    with pytest.raises(ValueError):
        stores.read_current(spark, path)
    first = stores.publish_current(spark.range(3), path, True)
    spark.range(9).write.parquet(f"{path}/versions/half")  # written, not committed
    (tmp_path / "cur" / "log" / f"{1:020d}").write_text("half")  # an entry whose writer has not ended
    assert stores.current_version(spark, path) == first and stores.read_current(spark, path).count() == 3
    (tmp_path / "cur" / "log" / f"{1:020d}").unlink()
    versions = [stores.publish_current(spark.range(n), path, True) for n in (4, 5, 6)]
    assert stores.current_version(spark, path) == versions[-1] and stores.read_current(spark, path).count() == 6


def test_an_entry_is_created_once(spark, tmp_path):
    log = stores.Log(spark, str(tmp_path))
    assert log.create(0, "a") and not log.create(0, "b") and log.entries() == {0: "a"}
