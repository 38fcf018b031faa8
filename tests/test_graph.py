import random

from sparkloom.operators import graph


def test_components(spark):
    rng = random.Random(4)
    for n, m in ((60, 40), (200, 150), (50, 0)):
        edges = [(rng.randrange(n), rng.randrange(n), "x") for _ in range(m)] + [(i, i + 1, "x") for i in range(1000, 1060)] + [(2000, 2000 + i, "x") for i in range(1, 50)] + [(None, 3, "x"), (7777, 7777, "x")]
        boss = {}

        def top(x):
            while boss.setdefault(x, x) != x:
                x = boss[x]
            return x

        for a, b, _ in edges:
            if a is not None:
                a, b = sorted((top(a), top(b)))
                boss[b] = a
        df = spark.createDataFrame(edges, "a long, b long, node string")
        assert {r.node: r.component for r in graph.connected_components(df).collect()} == {x: top(x) for x in list(boss)}
    assert graph.connected_components(df.where("false")).count() == 0


def test_pagerank(spark):
    e = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("c", "d", 0.5)]
    got = {r.node: r.rank for r in graph.pagerank(spark.createDataFrame(e, "a string, b string, weight double"), rounds=40).collect()}
    nodes = "abcd"
    w = {}
    for a, b, x in e:
        w[a, b] = w[b, a] = x
    rank = {n: 0.25 for n in nodes}
    for _ in range(40):
        rank = {n: 0.15 / 4 + 0.85 * sum(rank[m] * w[m, n] / sum(w.get((m, k), 0) for k in nodes) for m in nodes if (m, n) in w) for n in nodes}
    assert all(abs(got[n] - rank[n]) < 1e-6 for n in nodes) and abs(sum(got.values()) - 1) < 1e-6


def test_paths(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.7), ("a", "c", 0.5), ("c", "d", 0.8)], "a string, b string, confidence double")
    got = {(r.end, r.path): r.confidence for r in graph.bounded_paths(e, spark.createDataFrame([("a",)], "id string"), 3).collect()}
    assert got[("c", "a>b>c")] == 0.7 and got[("c", "a>c")] == 0.5 and got[("d", "a>b>c>d")] == 0.7 and ("a", "a") not in got
    assert {r.node for r in graph.neighbours(e, spark.createDataFrame([("a",), ("b",)], "id string")).collect()} == {"c"}
    assert {r.node for r in graph.bridges(e, spark.createDataFrame([("a",), ("b",)], "id string")).collect()} == {"c"}
