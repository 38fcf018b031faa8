import numpy as np

from sparkloom.operators import knowledge as k


def test_walk(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "a string, b string")
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("z", "9")], "entity string, chunk string")
    s = spark.createDataFrame([("a",), ("a",), ("z",)], "x string")
    assert sorted(map(tuple, k.walk_to_chunks(e, m, s).collect())) == [("a", "1", 0), ("a", "2", 1), ("a", "3", 1), ("a", "4", 2), ("z", "9", 0)]


def test_quotable_and_legs(spark):
    h = spark.createDataFrame([("card1", 0.9), ("x", 0.5), ("c1", 0.7)], "id string, score double")
    src = spark.createDataFrame([("card1", "c1"), ("card1", "c2")], "card string, chunk string")
    assert sorted(map(tuple, k.quotable(h, src).collect())) == [("c1", 0.9), ("c2", 0.9), ("x", 0.5)]
    leg = lambda *r: spark.createDataFrame(list(r), "id string, embedding array<double>")
    out = k.multi_vector({"chunk": leg(("a", [1.0, 0.0]), ("b", [0.6, 0.8])), "section": leg(("a", [0.9, 0.1]), ("c", None))}, [1.0, 0.0], "id")
    assert [r.id for r in out.collect()] == ["a", "b"]


def test_merge(spark):
    x = np.array([[1.0, 0.0], [0.99, 0.05], [0.0, 1.0], [1.0, 0.01], [0.0, 0.0]])
    assert k.merge_unit([5, 3, 4, 9, 8], ["p", "p", "p", "o", "p"], ["c"] * 5, x, 0.8) == [3, 3, 4, 9, 8]
    df = spark.createDataFrame([("u", 1, "p", "c", [1.0, 0.0]), ("u", 2, "p", "c", [1.0, 0.001]), ("u", 2, "p", "c", [1.0, 0.001]), ("u", 3, "p", "c", None), ("u", 4, "p", "c", [1.0]), ("v", 7, "p", "c", [1.0, 0.0])], "unit string, id long, kind string, chunk string, v array<double>")
    assert {r.id: r.cluster for r in k.merge_mentions(df, "unit", "id", "kind", "chunk", "v").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 7: 7}


def test_versions_and_cascade(spark):
    t = lambda *x: spark.createDataFrame([("t", y) for y in x], "tenant string, term string")
    none = spark.createDataFrame([], "tenant string, version int, signature string")
    first = k.next_version(none, t("a", "B"))
    assert first.first().version == 1 and k.next_version(first, t(" b", "A ")).first().version == 1 and k.next_version(first, t("c")).first().version == 2
    c = spark.createDataFrame([("d1", "c1"), ("d2", "c2")], "doc_id string, chunk string")
    m = spark.createDataFrame([("x", "c1"), ("y", "c1"), ("y", "c2"), ("z", "c2")], "entity string, chunk string")
    e = spark.createDataFrame([("x", "y"), ("y", "z")], "a string, b string")
    kc, km, ke = k.delete_documents(spark.createDataFrame([("d1",)], "d string"), c, m, e)
    assert [tuple(r) for r in kc.select("chunk").collect()] == [("c2",)] and {r.entity for r in km.collect()} == {"y", "z"} and [tuple(r) for r in ke.collect()] == [("y", "z")]
