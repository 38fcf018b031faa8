import datetime as dt
import json

from pyspark.sql import functions as F

from sparkloom.operators import drift

T = dt.datetime(2024, 1, 1)
FILES = "id string, name string, container_id string, created_at timestamp, file_id string, path string"
META = "file_id string, columns_info string, ingested_at timestamp, name string"


def months(spark, cols, records=(), names=None):
    files = [(f"f{i}", (names or {}).get(i, f"AP_Invoices_ABC_2024_{i + 1:02}.csv"), "ct", T, "clash", "clash") for i in range(len(cols))]
    meta = [(f"f{i}", c if c is None or isinstance(c, str) else json.dumps(c), T + dt.timedelta(i), "clash") for i, c in enumerate(cols)]
    rows = [(f"f{i}", n, r if r is None or isinstance(r, str) else json.dumps(r), "x") for i, n, r in records]
    return spark.createDataFrame(files + files[:1], FILES), spark.createDataFrame(meta + meta[:1], META), spark.createDataFrame(rows, "file_id string, row_no int, record string, value string")


def col(n, t=None):
    return {"name": n, "type": t}


def test_changes(spark):
    cols = [
        [col("plant", "string"), col("Qty ", "int64"), col("due", "date32[day]")],
        [{"column": "site", "dtype": "large_string"}, {"column": "qty", "dtype": "int32"}, {"column": "due", "dtype": "timestamp[us]"}],
        ["site", "QTY", "new_flag"],
        [col("site", "string"), col("qty", "double"), col("new_flag", "bool")],
        [col("site", "string"), col("qty", "double"), col("new_flag", "string")],
    ]
    records = [(i, n, {("plant" if i == 0 else "site"): f"PL0{n}", "qty": n}) for i in range(5) for n in range(4)]
    files, meta, rows = months(spark, cols, records)
    got = {tuple(r)[2:] for r in drift.changes_of(drift.follow(files, meta, rows)).collect()}
    assert got == {("2024_02", "renamed", "plant", "site"), ("2024_03", "removed", "due", ""), ("2024_03", "added", "", "new_flag"), ("2024_04", "retyped", "qty", "qty"), ("2024_05", "retyped", "new_flag", "new_flag")}


def test_newest_row_and_two_formats(spark):
    files, meta, rows = months(spark, [[col("a", "string")], [col("a", "string"), col("b", "string")], [col("a", "string"), col("b", "string")]], names={2: "ap_invoices_abc_202402_pipe.txt"})
    stale = spark.createDataFrame([("f1", json.dumps([col("z", "bool")]), T - dt.timedelta(9), ""), ("f2", None, T + dt.timedelta(99), ""), ("f2", "[]", T + dt.timedelta(98), ""), ("f2", "no json", T + dt.timedelta(97), "")], META)
    got = {tuple(r)[1:] for r in drift.changes_of(drift.follow(files, meta.union(stale), rows)).collect()}
    assert got == {("AP_INVOICES_ABC", "2024_02", "added", "", "b")}


def test_unify(spark):
    cols = [[col("amount", "string"), col("day", "string"), col("ok", "bool")], [col("amount", "double"), col("day", "date32[day]"), col("ok", "bool")]]
    records = [(0, 1, {"amount": "1 234,50", "day": "03.02.2024", "ok": "Y", "more": {"x": {"y": 1}}}), (0, 2, {"amount": "none", "day": None, "ok": False}), (0, 3, {"amount": " ", "day": "06.02.2024", "ok": "maybe"}), (1, 1, {"Amount": 7, "day": "2024-02-05"}), (1, 2, None), (1, 3, "{broken"), (1, 1, {"Amount": 7, "day": "2024-02-05"})]
    files, meta, rows = months(spark, cols, records)
    followed = drift.follow(files, meta, rows)
    unified = drift.unify(files, rows, followed)
    got = {(r.file_id, r.row_no): ({k: next((x for x in v[1:] if x is not None), None) for k, v in r.fields.items()}, r.failed) for r in unified.collect()}
    assert got["f0", 1] == ({"amount": 1234.5, "day": dt.date(2024, 2, 3), "ok": True, "more.x.y": "1"}, [])
    assert got["f0", 2] == ({"amount": None, "day": None, "ok": False}, ["amount"]) and got["f0", 3] == ({"amount": None, "ok": None, "day": dt.date(2024, 2, 6)}, ["ok"])
    assert got["f1", 1] == ({"amount": 7.0, "day": dt.date(2024, 2, 5)}, []) and len(got) == 4
    typed = drift.project_table(unified, [("amount", "fraction"), ("day", "date"), ("ok", "boolean")])
    assert dict(typed.dtypes)["amount"] == "double" and sorted((r.file_id, r.row_no, r.amount, str(r.day), r.ok) for r in typed.collect())[0] == ("f0", 1, 1234.5, "2024-02-03", True)
    seen = {(r.period_key, r.column_name): (r.declared, r.observed, r.n_values) for r in drift.observed_types(files, meta, rows).collect()}
    assert seen["2024_01", "ok"] == ("boolean", "mixed", 3) and seen["2024_02", "amount"] == ("fraction", "whole", 1) and seen["2024_01", "more.x.y"] == (None, "whole", 1) and seen["2024_02", "day"] == ("date", "date", 1)


def test_records_at_any_depth():
    deep = '{"a": ' * 200 + "1" + "}" * 200
    assert drift.leaves_of(deep) == [(".".join("a" * 200), "whole", "1")] and drift.leaves_of("[1]") is None and drift.leaves_of("NaN") is None and drift.leaves_of('{"a": NaN}') is None and drift.leaves_of(None) is None
    assert sorted(drift.leaves_of('{" A ": 1.50, "b": [1, {"c": 2}], "d": null, "e": {}, "f": "x"}')) == [("a", "fraction", "1.50"), ("b", "nested", '["1", {"c": "2"}]'), ("d", "null", None), ("f", "text", "x")]
    assert drift.typed_value("", "boolean") == (None, False) and drift.typed_value("maybe", "boolean") == (None, True) and drift.typed_value("45056", "date") == (dt.date(2023, 5, 10), False) and drift.typed_value("1.5", "whole") == (None, True) and drift.typed_value("", "text") == ("", False)


def test_casts_agree_with_the_expressions(spark):
    texts = ["2024-03-01T00:00", "1.234,5", "1,234.50", "05-Mar-2024", "$ 12", "x", "20240301", "03.02.2024", "31/12/2023", "32.01.2024", "1e3", "-5", "+7,25", "2023/01/09", "12,345", "1.2.3", "", "NaN", "inf"]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select("v", drift.number_value(F.col("v")).alias("n"), drift.date_value(F.col("v")).alias("d")).collect()
    for r in got:
        if r.v.lower() not in ("nan", "inf"):  # words, not numbers, when a value is cast
            assert drift.read_number(r.v) == r.n, r.v
        assert drift.read_date(r.v) == r.d, r.v


def test_a_pair_proven_elsewhere_needs_no_further_proof(spark):
    files, meta, rows = [], [], []
    for t in range(5):
        for m in range(2):
            name = "due" if m == 0 else "pay_until"
            files.append((f"f{t}{m}", f"T{'ABCDE'[t]}_Items_2024_{m + 1:02}.csv", "ct", T, "", ""))
            meta.append((f"f{t}{m}", json.dumps([col(name, "int64"), col("k", "string")]), T, ""))
            # the last table's values are far apart
            rows += [(f"f{t}{m}", n, json.dumps({name: (n + 1) * (10 if t < 4 else 3 + 40_000 * m)}), "") for n in range(4)]
    args = spark.createDataFrame(files, FILES), spark.createDataFrame(meta, META), spark.createDataFrame(rows, "file_id string, row_no int, record string, value string")
    got = {(r.table_name, r.change_kind) for r in drift.changes_of(drift.follow(*args)).collect()}
    assert got == {(f"T{x}_ITEMS", "renamed") for x in "ABCDE"}
    alone = [a.where(F.col(a.columns[0]).like("f4%")) for a in args]
    assert {r.change_kind for r in drift.changes_of(drift.follow(*alone)).collect()} == {"removed", "added"}


def test_empty_and_values(spark):
    files, meta, rows = months(spark, [["a"]])
    assert drift.follow(files.where("false"), meta, rows).count() == 0 == drift.follow(files, meta.where("false"), rows).count()
    df = spark.createDataFrame([("2024-03-01T00:00",), ("1.234,5",), ("1,234.50",), ("05-Mar-2024",), ("$ 12",), ("x",), (None,), ("20240301",)], "v string").select(drift.number_value(F.col("v")).alias("n"), drift.date_value(F.col("v")).alias("d")).collect()
    assert [r.n for r in df] == [None, 1234.5, 1234.5, None, 12.0, None, None, 20240301.0] and [str(r.d) for r in df] == ["2024-03-01", "None", "None", "2024-03-05", "None", "None", "None", "2024-03-01"]


def test_names():
    for a, b in (("net_amount", "netamt"), ("fiscal_year", "fy"), ("is_partial", "part_delivery"), ("delivery_date", "dlv_dt"), ("due_date", "payment_due")):
        assert drift.name_likeness(a, b) >= 0.6, (a, b)
    for a, b in (("net_amount", "tax_amount"), ("due_date", "posting_date"), ("is_blocked", "is_partial")):
        assert drift.name_likeness(a, b) < 0.5, (a, b)
