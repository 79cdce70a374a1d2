import itertools

import numpy as np

from tidemark.llm import embedding_dedup as ed


def brute(rows):
    ok = {i: np.array(v, float) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: y for i, _, y in rows}
    links = {i: set() for i, *_ in rows}
    for a, b in itertools.combinations(ok, 2):
        if label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.sqrt(ok[a] @ ok[a]) * np.sqrt(ok[b] @ ok[b])) >= 0.98:
            links[a].add(b)
            links[b].add(a)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


def run(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(df).collect()}


def test_equals_brute_force_with_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(ed, "TILE_ROWS", 16)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 24))
    rows = []
    for i in range(260):
        v = base[i % 12] + rng.normal(size=24) * rng.choice([0.01, 0.1, 0.2, 3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3) if i % 17 else None))
    assert run(spark, rows) == brute(rows)


def test_vectors_that_cannot_link(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 3.0], 0), (7, [1.0, float("nan"), 3.0], 0), (8, [float("inf"), 2.0, 3.0], 0), (9, [], 0), (10, [1.0, 2.0], 0), (11, v, 1), (12, [1e200, 2e200, 3e200], 0)]
    got = run(spark, rows, "double")
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[12] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int, n_links int, tile string")
    assert ed.near_duplicates(df).count() == 0


def test_suffix_bound_loses_no_pair():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 32))
    b = np.concatenate([a[:30] + rng.normal(size=(30, 32)) * 0.05, rng.normal(size=(30, 32))])
    basis = ed.bases({32: ed.unit(a).T @ ed.unit(a)})[32]
    got = {(int(i), int(j)) for x, y in ed.tile_links(a, b, basis, 0.98, False) for i, j in zip(x, y)}
    want = {(i, j) for i in range(60) for j in range(60) if ed.unit(a)[i] @ ed.unit(b)[j] >= 0.98}
    assert got == want and want


def test_equal_vectors_repeated_and_null_ids(spark):
    v, w, u = [1.0, 2.0, 3.0], [1.0, 2.0, 3.05], [-3.0, 1.0, 0.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, 0), (4, w, 0), (5, u, 0), (5, u, 1), (6, u, 1), (7, u, 0), (7, u, 0), (None, v, 0), (None, v, 0), (8, v, 2), (9, v, 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(df).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 3, 5, True), (5, 3, 5, True), (6, 1, 5, False), (7, 4, 5, False), (7, 4, 5, False)]
    assert got == sorted([*want, (None, 0, None, True), (None, 0, None, True), (8, 1, 8, True), (9, 1, 8, False)], key=str)


def test_many_equal_vectors_are_one_class(spark):
    df = spark.range(20_000).selectExpr("id AS vec_id", "array(1F, 2F, cast(id % 2 AS float)) AS embedding", "1 AS label")
    classes, members = ed.classes_of(ed.placed_vectors(df, {3: np.eye(3)}))
    assert classes.count() == 2 and members.count() == 20_000
    got = ed.near_duplicates(df)
    assert got.where("n_links = 9999").count() == 20_000 and {r[0] for r in got.select("component_id").distinct().collect()} == {0, 1}
