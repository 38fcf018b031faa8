import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import hierarchy as h

SCHEMA = "id string, name string, parent_id string, updated_at timestamp, depth string"
T = dt.datetime(2024, 1, 1)


def got(spark, rows, **k):
    df = spark.createDataFrame([(i, i.upper() if i else None, p, T, "clash") for i, p in rows], SCHEMA)
    return {r.id: r for r in h.build_hierarchy(df, **k).collect()}


def test_cases(spark):
    rows = [("a", None), ("b", "a"), ("b", "a"), ("c", " B\t"), ("d", "gone"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), (None, "a")]
    for limit in (100, 0):  # 0: every component goes the way of the oversized
        out = got(spark, rows, max_volume=limit)
        assert {k: (r.root_id, r.depth) for k, r in out.items()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0), "x": ("y", -1), "y": ("y", -1), "z": ("y", -1), "s": ("s", -1)}
        assert out["c"].path == "A/B/C" and out["c"].ancestor_ids == ["a", "b"] and out["a"].n_descendants == 2 and out["x"].path is None


def test_newest_row_and_empty(spark):
    df = spark.createDataFrame([("a", "A", None, T, ""), ("b", "old", None, T, ""), ("b", "new", "a", T + dt.timedelta(1), "")], SCHEMA)
    assert {r.id: r.path for r in h.build_hierarchy(df).collect()} == {"a": "A", "b": "A/new"}
    assert h.build_hierarchy(df.where("false")).count() == 0
    assert [tuple(r) for r in h.descendants(h.build_hierarchy(df)).collect()] == [("a", "b", 1)]


def test_long_chain_and_loop(spark):
    n = 150
    rows = [(f"n{i:04}", f"n{i - 1:04}" if i else None) for i in range(n)] + [(f"l{i:04}", f"l{(i + 1) % 37:04}") for i in range(37)] + [(f"t{i:04}", f"t{i - 1:04}" if i else "l0005") for i in range(90)]
    out = got(spark, rows)
    assert out["n0149"].depth == n - 1
    assert {r.root_id for k, r in out.items() if k[0] in "lt"} == {"l0000"} and out["t0080"].on_loop is False and out["l0001"].on_loop


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 14), min_size=1, max_size=15))
def test_walk_against_climbing(parents):
    keys = [str(i) for i in range(len(parents))]
    up = [str(p) if 0 <= p < len(keys) else None for p in parents]
    for k, root, depth, ancestors, *_ in h.walk_component(keys, up, keys):
        seen, x = [], k
        while up[int(x)] is not None and x not in seen:
            seen.append(x)
            x = up[int(x)]
        if x in seen:
            assert depth == -1 and root == min(seen[seen.index(x) :])
        else:
            assert (root, depth, ancestors) == (x, len(seen), ([*seen, x][::-1])[:-1])


def test_canonical_id(spark):
    u = "0ee9e0aa-56e5-4c55-a037-556187c8aa9e"
    df = spark.createDataFrame([(x,) for x in (u, u.upper(), "{" + u + "}", "urn:uuid:" + u, u.replace("-", ""), f" {u} ", f" {u}\t", f"\u00a0{u}\n")], "x string")
    assert {r[0] for r in df.select(h.canonical_id(F.col("x"))).collect()} == {u}


def test_deep_chain_without_paths(spark):
    n = 300
    rows = [(f"n{i:05}", f"n{i - 1:05}" if i else None) for i in range(n)]
    for limit in (10_000, 100):
        out = got(spark, rows, paths=False, max_volume=limit)
        assert out[f"n{n - 1:05}"].depth == n - 1 and {r.root_id for r in out.values()} == {"n00000"} and out["n00100"].path is None


def test_joins_against_walk_on_loops(spark):
    rows = [(f"l{i:02}", f"l{(i + 1) % 7:02}") for i in range(7)] + [(f"t{i:02}", f"t{i - 1:02}" if i else "l03") for i in range(21)] + [("u0", "t05"), ("u1", "u0"), ("s", "s"), ("v", "s"), ("p", "q"), ("q", "p"), ("r", None), ("r1", "r"), ("r2", "r1")]
    for paths in (True, False):
        walked, joined = got(spark, rows, paths=paths), got(spark, rows, paths=paths, max_volume=0)
        columns = list(next(iter(walked.values())).asDict())
        assert {k: [r[c] for c in columns] for k, r in joined.items()} == {k: [r[c] for c in columns] for k, r in walked.items()}
        assert {k for k, r in joined.items() if r.on_loop} == {*(f"l{i:02}" for i in range(7)), "s", "p", "q"}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(-1, 19), min_size=1, max_size=20))
def test_both_ways_are_equal_on_any_forest(spark, parents):
    rows = [(f"k{i:02}", f"k{p:02}" if p >= 0 else None) for i, p in enumerate(parents)]
    assert got(spark, rows, max_volume=0) == got(spark, rows)
