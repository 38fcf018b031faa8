import itertools

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.operators import board, cleaning, documents, profiling, relate, search


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_scalars(spark):
    assert [one(spark, v, scalars.normal_key) for v in (" 000123 ", "N/A", "A  b", "0", None, "")] == ["123", None, "a b", "0", None, None]
    assert one(spark, "12.5 %", scalars.number_of) == 0.125 and one(spark, "€ 1 234", scalars.number_of) == 1234 and one(spark, "abc", scalars.number_of) is None
    assert str(one(spark, "19 Mar 2018", scalars.date_of)) == "2018-03-19" and one(spark, "2018", scalars.date_of) is None and one(spark, "JAN-25", scalars.date_of) is None and str(one(spark, "43000", scalars.date_of)) == "2017-09-22"
    assert one(spark, "custom:date:posting", scalars.role_kind) == ("date", "posting") and one(spark, "x", scalars.role_kind) is None
    assert one(spark, "x/y/1a2b3c4d_PROC_Orders_2023_06_tab.txt", scalars.logical_table) == "PROC_ORDERS" and one(spark, "PROC_Orders_2023-06.csv", scalars.file_period) == "2023_06"
    assert one(spark, "sales of $1.5M in May", scalars.prose_number) == 1.5e6
    assert one(spark, "Purchase order number", scalars.acronym) == "pon" and one(spark, "A-b C!", scalars.slug) == "a_b_c"
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(scalars.cosine(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, 0]


def test_cleaning(spark):
    df = spark.createDataFrame([("Total", "9"), ("Max Smith", "1"), ("----", "==="), (" ", None), ("a​b\n c", "pending"), ("x", "-")], "label string, v string")
    judged = cleaning.judge_rows(df)
    assert [r._reason for r in judged.collect()] == ["garbage_keyword", "garbage_keyword", "separator", "all_empty", None, None]
    assert {r.reason: r.n_rows for r in cleaning.quarantine_summary(judged).collect()} == {"garbage_keyword": 2, "separator": 1, "all_empty": 1}
    assert [tuple(r) for r in cleaning.clean_strings(df).collect()][4:] == [("ab c", None), ("x", None)]
    t = spark.createDataFrame([("001", "yes", "2024-01-02", "$5", "text"), ("002", "no", "03.02.2024", "7%", "more"), (None, None, None, None, None)], "sku string, flag string, day string, amount string, note string")
    kinds = {n: k for n, k, _ in cleaning.detect_types(t)}
    assert kinds == {"sku": "identifier", "flag": "boolean", "day": "date", "amount": "numeric", "note": "text"}
    assert cleaning.convert(t, cleaning.detect_types(t)).first().sku == "001" and cleaning.detect_types(t.where("false"))[1][1] == "text"


def test_profiles_of_empty_and_odd_tables(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (float("inf"), "a"), (2.0, None), (None, "b")], "v double, column_name string")
    r = {x.column_name: x for x in profiling.sample_stats(df).collect()}["v"]
    assert (r.n_nulls, r.n_unique, r.mean_value) == (3, 1, 2.0)
    assert profiling.column_profile(df.where("false")).collect()[0].null_pct is None
    assert profiling.value_counts(df, ["column_name"], 1).collect()[0].value == "a"
    assert [c["kind"] for c in profiling.result_shape(spark.createDataFrame([("2024-01", 1.0, "x")], "month string, total double, name string"))] == ["temporal", "measure", "category"]


def test_join_discovery(spark):
    ids = [f"C{i:04}" for i in range(300)]
    tables = {"master": spark.createDataFrame([(i, "x") for i in ids], "customer_id string, kind string"), "sales": spark.createDataFrame([(ids[i % 200].lower() + " ", "x") for i in range(900)] + [(None, "x")], "customer_id string, kind string")}
    v = relate.hashed_values(relate.column_values(tables, [("master", "customer_id"), ("sales", "customer_id"), ("master", "kind"), ("sales", "kind")]))
    reg = {(r.file_name, r.column_name): r for r in relate.key_registry(v).collect()}
    assert reg["master", "customer_id"].key_kind == "pk" and reg["sales", "customer_id"].key_kind == "fk" and reg["sales", "customer_id"].cardinality == 200
    e = relate.edges(relate.fingerprint_overlap(v), relate.key_registry(v)).collect()
    assert len(e) == 1 and e[0].overlap == 1 and e[0].relationship_type == "one_to_many" and 0.9 < e[0].confidence <= 0.98
    assert relate.fingerprint_overlap(v.where("false")).count() == 0


@pytest.mark.parametrize(
    ("same", "ubiquity", "overlap", "a", "b", "conf", "rel", "risky", "want"),
    [
        (True, 0.27, 0.64, 312, 300, 0.69, "many_to_many", True, "approved"), (True, 0.7, 0.9, 312, 300, 0.9, "one_to_many", False, "candidate"), (True, 0.2, 1.0, 300, 300, 0.9, "one_to_one", False, "candidate"), (True, 0.2, 0.9, 7, 300, 0.9, "one_to_many", False, "candidate"),
        (True, 0.2, 0.4, 90, 300, 0.9, "one_to_many", False, "candidate"), (False, 0.2, 0.9, 90, 300, 0.9, "one_to_many", True, "candidate"), (False, 0.2, 0.9, 90, 300, 0.9, "many_to_many", False, "candidate"), (False, 0.2, 0.9, 90, 300, 0.73, "one_to_many", False, "approved"), (False, 0.2, 0.9, 90, 300, 0.7, "one_to_many", False, "candidate"),
    ],
)
def test_approval(spark, same, ubiquity, overlap, a, b, conf, rel, risky, want):
    row = spark.range(1).select(relate.approval(*[F.lit(x) for x in (same, ubiquity, overlap, a, b, conf, rel, risky, False)]).alias("x")).first().x
    assert row.status == want and (row.reason is None) == (want == "approved")


def test_search(spark):
    df = spark.createDataFrame([(1, "red apple red"), (2, "green apple"), (3, None), (4, ""), (5, "blue")], "id long, text string")
    assert [r.id for r in search.bm25(df, ["red", "apple"], "id", "text").collect()] == [1, 2] and search.bm25(df.where("false"), ["a"], "id", "text").count() == 0
    assert [r.id for r in search.trigram_search(df, "aple", "id", "text").collect()] == [1, 2]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id long, v array<double>")
    assert [r.id for r in search.vector_search(v, [1.0, 0.0], "id", "v").collect()] == [1, 2] and search.vector_search(v, [0.0, 0.0], "id", "v").count() == 0
    got = {(r.query_id, r["rank"]): r.id for r in search.exact_topk(v, v, "id", "v", 2, block=2).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}
    lists = [spark.createDataFrame(x, "id long, score double") for x in ([(1, 3.0), (2, 2.0)], [(2, 9.0), (3, 8.0)])]
    assert [r.id for r in search.rrf(lists, "id").collect()] == [2, 1, 3]
    acl = spark.createDataFrame([("a", "t", '{"users":["u"]}'), ("b", "t", '{"groups":["g"]}'), ("c", "t", "broken"), ("d", "x", '{"public":true}'), ("e", "t", '{"public":true}')], "chunk_id string, tenant_id string, acl string")
    ok, denied = search.acl_filter(acl, "u", ["g"], "t")
    assert {r.chunk_id for r in ok.collect()} == {"a", "b", "e"} and {r.chunk_id for r in denied.collect()} == {"c", "d"}
    assert [r.id for r in search.budgeted(df.where("id < 3"), "id", "text", 1).collect()] == [1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=30), st.integers(3, 20), st.integers(0, 6))
def test_chunks_keep_every_sentence(sizes, size, overlap):
    sentences = [" ".join([f"w{i}"] * n) + "." for i, n in enumerate(sizes)]
    chunks = documents.pack_sentences(" ".join(sentences), size, overlap)
    seen = [s for c in chunks for s in documents.SENTENCE.split(c)]
    assert list(dict.fromkeys(seen)) == sentences
    for c in chunks:
        assert len(c.split()) <= max(size, overlap + max(sizes))


def test_documents(spark):
    d = spark.createDataFrame([(1, "The Gross Domestic Product (GDP) rose. VAT stands for Value Added Tax today."), (2, None)], "id long, text string")
    assert {(r.short, r.long_form) for r in documents.definitions(d, "id", "text").collect()} == {("GDP", "Gross Domestic Product"), ("VAT", "Value Added Tax")}
    s = spark.createDataFrame([("a", "see PO-1 and PO-2"), ("b", "PO-1, PO-2"), ("c", "PO-9"), ("d", None)], "k string, text string")
    assert [tuple(r) for r in documents.value_links(s, "k", "text").collect()] == [("a", "b", 2)]
    c = spark.createDataFrame([(1, "delivery to warehouse was approved", "t"), (2, "delivery to warehouse was not approved", "t"), (3, "something else entirely", "t")], "k long, text string, topic string")
    assert [tuple(r)[:2] for r in documents.conflicts(c, "k", "text", "topic").collect()] == [(1, 2)]
    t = spark.createDataFrame([(1, "| h |\n|---|\n| a |\n| b |")], "k long, text string")
    assert [r.chunk_text for r in documents.table_chunks(t, "k", "text").orderBy("chunk_no").collect()] == ["| h |\n| a |", "| h |\n| b |"]


def test_conflicts_by_frequent_and_short_words(spark):
    rows = [(i, f"pay the tax {'not ' if i % 3 == 0 else ''}in w{i % 5}x", "t") for i in range(40)] + [(90, "pay tax", "u"), (91, "no tax pay", None)]
    c = spark.createDataFrame(rows, "k long, text string, topic string")
    words = {k: set(t.split()) - {"the", "not", "in", "no"} for k, t, _ in rows}
    want = {(a, b, len(words[a] & words[b])) for a in range(40) for b in range(a + 1, 40) if (a % 3 == 0) != (b % 3 == 0)}
    for block_rows in (1000, 6):
        got = [tuple(r) for r in documents.conflicts(c, "k", "text", "topic", block_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert documents.conflicts(c.where("false"), "k", "text", "topic").count() == 0


def test_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 1.0) for i, j in itertools.combinations(range(5), 2)]
    e = spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0", 0.2), ("x", "y", 1.0), (None, "a1", 1.0)], "a string, b string, weight double")
    got = {}
    for r in documents.communities(e).collect():
        got.setdefault(r.community, set()).add(r.node)
    assert got == {"a0": {f"a{i}" for i in range(5)}, "b0": {f"b{i}" for i in range(5)}}
    by_labels = documents.communities(e, max_edges=3).collect()
    assert {r.node for r in by_labels} >= {f"a{i}" for i in range(5)} and documents.communities(e.where("false")).count() == 0


def test_boards(spark):
    p = spark.createDataFrame([("m", "t", 60.0), ("m", "t", 45.0), ("n", "t", 100.5)], "measure string, table_name string, value double")
    w = spark.createDataFrame([("m", "t", 100.0), ("n", "t", 100.0)], "measure string, table_name string, value double")
    assert {r.measure: r.double_counted for r in board.tie_out(p, w).collect()} == {"m": True, "n": False}
    m = spark.createDataFrame([("r", "a", "X "), ("r", "a", "y"), ("r", "b", "x"), ("r", "b", "y"), ("s", "a", "1"), ("s", "b", "2"), ("q", "a", None)], "role string, table_name string, member string")
    assert [tuple(r) for r in board.conformed_dimensions(m).collect()] == [("r", 1.0, 2)]
    used = spark.createDataFrame([("w", "a"), ("w", "b"), ("w", "c")], "widget string, table_name string")
    edges = spark.createDataFrame([("b", "a", 0.9, "one_to_many"), ("a", "c", 0.9, None)], "file_a string, file_b string, overlap double, relationship_type string")
    assert {(r.ta, r.tb) for r in board.unsafe_pairs(used, edges).collect()} == {("a", "c"), ("b", "c")}


def test_reconcile(spark):
    s = spark.createDataFrame([("p", str(i)) for i in range(4)] + [("q", "1")], "subject string, value string")
    m = spark.createDataFrame([("m1", 0.9, f"00{i}") for i in range(4)] + [("m2", 0.95, "1")], "master string, confidence double, value string")
    assert {r.subject: (r.master, r.outcome) for r in relate.reconcile_values(s, m).collect()} == {"p": ("m1", "LINKED"), "q": (None, "REFUSED")}
    f = spark.createDataFrame([("2024 ", "T", 2.0, 50.0)], "period string, unit string, rate double, volume double")
    t = spark.createDataFrame([("2024", "t", 104.0), ("2024", "t", 120.0)], "period string, unit string, total double")
    assert sorted(r.ties for r in relate.reconcile_grain(f, t).collect()) == [False, True]


def test_terms_with_signs_are_no_patterns(spark):
    df = spark.createDataFrame([(1, "We write C++ and a.b here"), (2, "axb c"), (3, "C")], "id int, text string")
    assert [r.id for r in search.bm25(df, ["c++"], "id", "text").collect()] == [1]
    assert [r.id for r in search.bm25(df, ["A.B", ""], "id", "text").collect()] == [1]


def test_as_of_join_against_looking_it_up(spark):
    import datetime as dt
    import random

    rnd = random.Random(2)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=rnd.randrange(200), hours=rnd.randrange(3))
    left = [(i, rnd.choice(["a", "a", "b", "c", None]), day() if i % 9 else None, "x") for i in range(120)]
    right = [(rnd.choice(["a", "b", None]), day() if i % 11 else None, rnd.randrange(1000)) for i in range(90)]
    got = relate.as_of_join(spark.createDataFrame(left, "id int, k string, ts timestamp, as_of_clash string"), spark.createDataFrame(right, "k string, ts timestamp, r int"), ["k"], "ts", "r", width_days=7)
    want = {i: max(((t2, r) for k2, t2, r in right if k is not None and k2 == k and t is not None and t2 is not None and t2 <= t), default=(None, None))[1] for i, k, t, _ in left}
    assert {r.id: r.as_of for r in got.collect()} == want
    empty = spark.createDataFrame([], "k string, ts timestamp, r int")
    assert [r.as_of for r in relate.as_of_join(spark.createDataFrame(left[:2], "id int, k string, ts timestamp, z string"), empty, ["k"], "ts", "r").collect()] == [None, None]
