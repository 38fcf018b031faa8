import datetime as dt

from pyspark.sql import functions as F

from sparkloom.operators import catalog

T = dt.datetime(2024, 1, 1)


def test_tags_pass_down(spark):
    rows = [("a", None, "hr"), ("b", "a", None), ("c", "b", "it"), ("d", "c", None), ("x", "y", "fin"), ("y", "x", None), ("z", None, None)]
    df = spark.createDataFrame([(i, i, p, t, T, "clash") for i, p, t in rows], "id string, name string, parent_id string, domain_tag string, updated_at timestamp, level string")
    assert {r.id: r.effective_tag for r in catalog.effective_tags(df).collect()} == {"a": "hr", "b": "hr", "c": "it", "d": "it", "x": "fin", "y": None, "z": None}
    assert catalog.effective_tags(df.where("false")).count() == 0


def test_newest_and_fingerprints(spark):
    df = spark.createDataFrame([("f", 1, "old"), ("f", 2, "new"), ("f", 2, "new"), ("g", None, None)], "k string, at int, v string")
    assert {r.k: r.v for r in catalog.newest(df, ["k"], ["at"]).collect()} == {"f": "new", "g": None}
    m = spark.createDataFrame([("1", '[{"name":"B"},{"name":"a "}]'), ("2", '["A","b"]'), ("3", '[{"column":"b","dtype":"x"},{"column":"a"}]'), ("4", "[]"), ("5", None), ("6", '{"a":"int","b":"text"}'), ("7", "junk")], "id string, columns_info string")
    got = {r.id: r.fingerprint for r in catalog.schema_fingerprints(m).collect()}
    assert len({got[i] for i in "1236"}) == 1 and got["1"] and {got[i] for i in "457"} == {None}


def test_budgets_and_picks(spark):
    df = spark.createDataFrame([("a", i, 4) for i in range(5)] + [("b", 0, 20), ("c", 0, None)], "g string, o int, n long")
    assert sorted((r.g, r.o) for r in catalog.within_budget(df, ["g"], ["o"], "n", 9).collect()) == [("a", 0), ("a", 1)]
    assert [(r.g, r.o) for r in catalog.breadth_first(df, "g", ["o"], 4).collect()] == [("a", 0), ("b", 0), ("c", 0), ("a", 1)]
    assert sorted((r.g, r.o) for r in catalog.weighted_pick(df, ["g"], ["o"], "n", 0.5).collect()) == [("a", 2), ("b", 0)]
    assert sorted((r.g, r.o, r.batch_no) for r in catalog.batches(df, "g", "o", "n", 3, 9).collect()) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 0, 0), ("c", 0, 0)]


def test_layout():
    assert catalog.column_order([50, 51, 52, 300, 301, 302]) == [0, 0, 0, 1, 1, 1]
    assert catalog.column_order([50, 51, 52]) == [0, 0, 0] and catalog.column_order([]) == [] and catalog.column_order([5]) == [0]
    assert catalog.column_order([300, 50, 51, 600, 301, 601]) == [1, 0, 0, 2, 1, 2]


def test_grid(spark):
    cells = spark.createDataFrame([("t", 0, 0, 1, 2, "head"), ("t", 1, 0, None, None, "a"), ("t", 1, 1, 1, 1, None)], "k string, row int, col int, row_span int, col_span int, content string")
    assert catalog.grid_markdown(cells, "k").first().markdown == "| head | head |\n|---|---|\n| a |  |"


def test_orphans_and_text(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None)], "e int, d string")
    assert [r.e for r in catalog.orphans(m, "e", "d", spark.createDataFrame([("a",), ("a",)], "x string")).collect()] == [2]
    df = spark.createDataFrame([("What is A, and how B?",), ("",), (None,)], "q string")
    assert [r[0] for r in df.select(catalog.question_parts(F.col("q"))).collect()] == [["is a", "b"], [], None]
    assert spark.range(1).select(catalog.likeness(F.lit("abc"), F.lit("abd"))).first()[0] > 0.6


def test_identities(spark):
    files = spark.createDataFrame([("1", "A_2024_01.csv", "c"), ("2", "A_2024_01.xlsx", "c"), ("3", "A_2024_02_tab.txt", "c"), ("4", "A_2024_03.csv", "c"), ("5", "nodate.csv", "c"), ("6", "A_2024_04.csv", "c")], "id string, name string, container_id string")
    cols = {"1": '["x"]', "2": '["X"]', "3": '["x"]', "4": '["y"]', "5": '["x"]', "6": None}
    meta = spark.createDataFrame([(k, T, v) for k, v in cols.items()], "file_id string, ingested_at timestamp, columns_info string")
    got = {r.file_id: r.table_name for r in catalog.identities(files, meta).collect()}
    assert set(got) == {"1", "3", "4"} and got["1"] == got["3"] == "A" and got["4"].startswith("A_S")


def test_scores_and_runs(spark):
    q = spark.createDataFrame([(1, "late purchase orders"), (2, ""), (3, None)], "id long, q string")
    e = spark.createDataFrame([("a", "purchase orders of vendors"), ("b", "orders"), ("c", None)], "e string, t string")
    assert [tuple(r) for r in catalog.score_catalog(q, e, "id", "q", "e", "t").orderBy("rank").collect()] == [(1, "a", 0.666667, 1), (1, "b", 0.333333, 2)]
    assert [tuple(r) for r in catalog.field_scores(e, "e", ["orders"], {"t": 2.0, "e": 1.0}).collect()] == [("a", 2.0), ("b", 2.0)]
    a, b = spark.createDataFrame([("x", 1.0), ("y", 5.0), ("n", 1.0)], "k string, v double"), spark.createDataFrame([("x", 1.05), ("y", 1.0), ("g", 1.0)], "k string, v double")
    assert {r.k: r.verdict for r in catalog.compare_runs(a, b, ["k"], "v", 0.1).collect()} == {"x": "same", "y": "better", "n": "added", "g": "gone"}
    g = spark.createDataFrame([("PO", "Purchase Order")], "short string, long_form string")
    assert {r.id: r.expanded for r in catalog.expand_terms(q.withColumn("q", F.concat("q", F.lit(" PO"))), "id", "q", g).collect()}[1] == "late purchase orders PO Purchase Order"
    one = spark.range(1).select(catalog.surface_forms(F.lit("What did Acme Foods sell to Bolt in 2024?")).alias("f"), catalog.page_class(F.lit(5), 20, F.lit(True), F.lit(False)).alias("p")).first()
    assert one.f[0] == "Acme Foods" and "Bolt" in one.f and one.p == "scanned"


def test_interval_join(spark):
    from sparkloom.operators import relate

    d = lambda s: dt.date.fromisoformat(s)
    p = spark.createDataFrame([(i, d("2024-01-01") + dt.timedelta(days=17 * i)) for i in range(40)] + [(99, None)], "p int, day date")
    spans = [(k, d("2024-01-01") + dt.timedelta(days=11 * k), d("2024-01-01") + dt.timedelta(days=11 * k + 7 * (k % 9) - 5)) for k in range(50)] + [(77, None, d("2024-05-05"))]
    i = spark.createDataFrame(spans, "i int, a date, b date")
    got = {(r.p, r.i) for r in relate.interval_join(p, i, "day", "a", "b", 10).collect()}
    assert got == {(x.p, s[0]) for x in p.collect() for s in spans if x.day and s[1] and s[1] <= x.day <= s[2]}


def test_budget_against_running_sums(spark):
    import random

    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), i, rnd.choice([0, 1, 5, 9, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, n int")
    want, used = set(), {}
    for k, i, n in sorted(rows, key=lambda r: r[1]):
        used[k] = used.get(k) if n is None else (used.get(k) or 0) + n
        if used[k] is not None and used[k] <= 60:
            want.add((k, i, used[k]))
    assert {(r.k, r.i, r.used) for r in catalog.within_budget(df, ["k"], ["i"], "n", 60, parts=5).collect()} == want
    assert catalog.within_budget(df.where("false"), ["k"], ["i"], "n", 60).count() == 0
