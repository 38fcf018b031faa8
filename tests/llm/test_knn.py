import numpy as np
import pytest

from sparkloom.llm import knn

SCHEMA = "id string, v array<float>, key string, list int"


def brute(x, keys, k):
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -2)
    return {keys[i]: [(keys[j], s[i, j]) for j in np.lexsort((keys, -s[i]))[:k]] for i in range(len(x))}


def data(n=3000, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dim))
    x = centres[rng.integers(0, 60, n)] + 0.3 * rng.normal(size=(n, dim))
    return x * rng.uniform(0.1, 9, (n, 1))


def test_recall(spark):
    x = data()
    keys = [f"k{i:05}" for i in range(len(x))]
    df = spark.createDataFrame([(k, [float(y) for y in v], "clash", 1) for k, v in zip(keys, x)], SCHEMA)
    want = brute(knn.unit(x), np.array(keys), 10)
    got: dict = {}
    for r in knn.nearest(df, "id", "v", 10, dim=8, list_rows=150).collect():
        got.setdefault(r.key_a, {})[r.key_b] = r.cosine
    hits = sum(b in got[a] for a, bs in want.items() for b, _ in bs)
    assert hits / (10 * len(x)) > 0.9
    assert all(len(v) == 10 for v in got.values())


@pytest.mark.parametrize("lists, small", [(50, 100_000), (1200, 0)])
def test_dirty_rows_copies_and_ties(spark, lists, small):
    rows = [(f"c{i:03}", [1.0, 0.0, 0.0], "x", 0) for i in range(40)] + [(f"c{i:03}", [1.0, 0.0, 0.0], "x", 0) for i in range(5)]
    rows += [("d", [2.0, 0.0, 0.0], "x", 0), ("e", [0.0, 1.0, 0.0], "x", 0), ("f", [0.0, 1.0, 0.001], "x", 0), ("far", [-1.0, -1.0, 5.0], "x", 0)]
    rows += [("n", None, "x", 0), ("z", [0.0, 0.0, 0.0], "x", 0), ("s", [1.0], "x", 0), ("q", [float("nan"), 1.0, 0.0], "x", 0), ("i", [float("inf"), 1.0, 0.0], "x", 0), (None, [1.0, 0.0, 0.0], "x", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got: dict = {}
    for r in knn.nearest(df, "id", "v", 10, dim=3, list_rows=lists, small=small).where("cosine >= 0.9").collect():
        got.setdefault(r.key_a, set()).add(r.key_b)
    assert got["c020"] == {f"c{i:03}" for i in range(10)} and got["c003"] == {f"c{i:03}" for i in range(11)} - {"c003"} == got["c003"]
    assert got["e"] == {"f"} and got["f"] == {"e"} and got["d"] == {f"c{i:03}" for i in range(10)}
    assert not {"n", "z", "s", "q", "i", "far", None} & set(got)


def test_empty(spark):
    assert knn.nearest(spark.createDataFrame([], SCHEMA), "id", "v", 10, dim=3).count() == 0


def test_copies_are_whole_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4)).round(3)
    rows = [(f"k{i:03}", [float(v) for v in x[i % 40]]) for i in range(130)]  # each vector three times or four
    df = spark.createDataFrame(rows, "id string, v array<float>")
    keys = np.array([r[0] for r in rows])
    want = brute(knn.unit(np.array([r[1] for r in rows])), keys, 5)
    for small in (0, 100_000):
        got: dict = {}
        for r in knn.nearest(df, "id", "v", 5, dim=4, small=small).collect():
            got.setdefault(r.key_a, []).append((r.key_b, r.cosine))
        assert {a: sorted(round(s, 3) for _, s in b) for a, b in got.items()} == {a: sorted(round(s, 3) for _, s in b) for a, b in want.items()}
        assert all({k for k, _ in got[a]} >= {k for k, s in want[a] if s > 0.99999} for a in want)


def test_large_lists_are_cut(spark):
    x = data(n=4000)
    keys = [f"k{i:05}" for i in range(len(x))]
    df = spark.createDataFrame([(k, [float(y) for y in v], "clash", 1) for k, v in zip(keys, x)], SCHEMA)
    want = brute(knn.unit(x), np.array(keys), 10)
    got: dict = {}
    # one list by its bound, cut into about 26 in its task
    for r in knn.nearest(df, "id", "v", 10, dim=8, list_rows=150, max_sample=16, split_rows=1000).collect():
        got.setdefault(r.key_a, set()).add(r.key_b)
    assert sum(b in got[a] for a, bs in want.items() for b, _ in bs) / (10 * len(x)) > 0.9


def test_pairs_near_the_bound_are_counted_from_the_vectors(spark):
    t = np.arccos(0.9)
    rows = [("a", [1.0, 0.0]), ("b", [float(np.cos(t - 1e-6)), float(np.sin(t - 1e-6))]), ("c", [float(np.cos(t + 3e-6)), float(-np.sin(t + 3e-6))])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    n = knn.nearest(df, "id", "v", 2, dim=2)
    for small in (0, 10):
        assert {tuple(r) for r in knn.similar_pairs(n, df, "id", "v", 0.9, dim=2, small=small).collect()} == {("a", "b")}
