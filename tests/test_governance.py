
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import governance as g
from sparkloom.plans import guards


def test_trust_and_quarantine(spark):
    files = spark.createDataFrame([("a", 0.9), ("b", 0.7), ("c", 0.1), ("d", None), ("e", 0.95)], "file_id string, score double")
    findings = spark.createDataFrame([("e", " ERROR"), ("e", "info"), ("a", "warning"), (None, "error"), ("e", None)], "file_id string, severity string")
    assert {r.file_id: r.state for r in g.sweep_trust(files, findings).collect()} == {"a": "TRUSTED", "b": "SHADOW", "c": "QUARANTINED", "d": "TRUSTED", "e": "QUARANTINED"}
    hits = spark.createDataFrame([(1, "x", "QUARANTINED"), (2, "x", None), (3, "y", "quarantined"), (4, None, "QUARANTINED"), (5, None, "SHADOW")], "id int, q string, state string")
    assert {r.id for r in g.drop_quarantined(hits, "q", "state").collect()} == {2, 3, 5}
    assert g.drop_quarantined(hits.where("false"), "q", "state").count() == 0


def test_roles(spark):
    roles = spark.createDataFrame([("f", 2, "a", "custom:entity_key:Order No"), ("f", 1, "b", "CUSTOM:entity_key:customer id"), ("f", 3, "c", "custom:additive_measure:net amount"), ("f", 4, "d", None), ("f", 5, "e", "odd"), ("h", 1, "x", "custom:attribute:vendor")], "file_id string, position int, column_name string, role string")
    (f, h) = sorted(g.entity_specs(roles).collect(), key=lambda r: r.file_id)
    assert (f.entity_name, f.primary_key, f.metrics, f.dimensions, f.attributes, f.confidence) == ("customer id", "b", ["c"], ["b", "a"], ["d", "e"], 0.9) and h.primary_key is None and h.confidence == 0.6
    assert {r.file_id: r.polarity for r in g.polarity(roles).collect()} == {"f": "customer", "h": "vendor"}
    assert [r.file_id for r in g.files_by_role(roles, spark.createDataFrame([("order of it", 0.2), ("vendor", 0.9)], "name string, confidence double"), floor=0.5).collect()] == ["h"]


def test_pins(spark):
    c = spark.createDataFrame([("e1", "t1", 0.9, True), ("e1", "t2", 0.9, False), ("e2", "t3", 0.9, True), ("e2", "t4", 0.95, True), ("e3", "t5", 0.5, True)], "entity string, table_name string, confidence double, corroborated boolean")
    assert {r[0] for r in g.pins(c).collect()} == {"t1"} and {r[0] for r in g.pins(c, guarded=False).collect()} == {"t1", "t2", "t3", "t4"}
    reg = spark.createDataFrame([("t1", "pk", 20, "custom:entity_key:order number"), ("t2", "pk", 3, "custom:entity_key:order number"), ("t2", None, 99, "custom:entity_key:order")], "table_name string, key_kind string, cardinality int, role string")
    got = g.corroborated(spark.createDataFrame([("order number", "t1", 0.9), ("order number", "t2", 0.9), ("", "t1", 0.9)], "entity string, table_name string, confidence double"), reg)
    assert {(r.entity, r.table_name): r.corroborated for r in got.collect()} == {("order number", "t1"): True, ("order number", "t2"): False, ("", "t1"): False}


def test_helpers(spark):
    assert g.chart_hint("the share of each", [{"a": "x", "b": 1}])["type"] == "pie" and g.chart_hint("monthly", [{"a": "x", "b": 1}])["type"] == "line" and g.chart_hint("", [{"a": "x"}]) is None and g.chart_hint("", []) is None
    assert g.dictionary_columns("c/erp_schema.csv", ["Field Name", "Description", "Notes"]) == {"field": "Field Name", "description": "Description", "notes": "Notes"} and g.dictionary_columns("c/erp.csv", ["field", "description"]) is None
    assert g.predicate_hint("order_id", "string", []) == "order_id = '<value>'" and g.predicate_hint("posted", "string", ["19-Mar-2018"]).startswith("try_to_timestamp") and g.predicate_hint("fiscal_year", "double", []) == "fiscal_year = 2024.0" and g.predicate_hint("total", "decimal(10,2)", []) == "total > 0"
    assert g.capacity(600, 45, 600, 1, most=100) == 45 and g.capacity(0, 45, 600, 1) == 1
    t = {"a": spark.createDataFrame([(1,), (2,)], "k int"), "b": spark.createDataFrame([(1,)], "z int")}
    cut, rest = g.slice_tables(t, "k", [2])
    assert cut["a"].count() == 1 and rest == ["b"]
    pages = spark.createDataFrame([("a", "indexed"), ("a", "failed"), ("b", "indexed"), ("c", "review"), ("d", "ocr"), ("d", "indexed"), ("e", None)], "doc_id string, status string")
    assert {r.doc_id: r.state for r in g.fold_status(pages).collect()} == {"a": "partial", "b": "indexed", "c": "failed", "d": "processing", "e": "processing"}
    df = spark.createDataFrame([(0.5, None), (None, None)], "a double, b double").select(g.answer_confidence({"a": (F.col("a"), 1.0), "b": (F.col("b"), 3.0)}).alias("c"))
    assert [r.c for r in df.collect()] == [0.5, None]


def test_logical_sql(spark):
    parts = {"Sales Orders": {"f1": spark.createDataFrame([(1, "x")], "id int, k string"), "f2": spark.createDataFrame([(2,)], "id int")}, "Item": {"f3": spark.createDataFrame([(1, 5.0)], "id int, v double")}}
    out = guards.logical_sql(spark, "SELECT id, k FROM sales_orders ORDER BY id", parts, {"f1", "f2"})
    assert [tuple(r) for r in out["rows"].collect()] == [(1, "x"), (2, None)] and out["files"] == ["f1", "f2"]
    out = guards.logical_sql(spark, "WITH t AS (SELECT * FROM SALES_ORDERS) SELECT sales_orders.id, i.v FROM sales_orders JOIN item AS i ON sales_orders.id = i.id WHERE 'from item' <> ''", parts, {"f1", "f3"})
    assert [tuple(r) for r in out["rows"].collect()] == [(1, 5.0)] and out["tables"] == ["Item", "Sales Orders"]
    with pytest.raises(PermissionError):
        guards.logical_sql(spark, "SELECT * FROM item", parts, {"f1"})
    with pytest.raises(PermissionError):
        guards.logical_sql(spark, "SELECT * FROM parquet.`/etc/x`", parts)
    with pytest.raises(KeyError):
        guards.logical_sql(spark, "SELECT * FROM other", parts)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_")]


def test_qualify_and_intent(spark):
    q = guards.qualify("SELECT a, 'qualify from' AS t FROM (SELECT 1 AS a UNION ALL SELECT 2) QUALIFY row_number() OVER (ORDER BY a DESC) = 1 ORDER BY a LIMIT 5")
    assert [tuple(r) for r in spark.sql(q).collect()] == [(2, "qualify from")] and guards.qualify("SELECT 1 AS qualify_me") == "SELECT 1 AS qualify_me"
    ok = lambda a, b: guards.keeps_intent(spark, a, b)
    base = "SELECT k, sum(cast(v AS int)) FROM t GROUP BY k"
    assert ok(base, base.replace("cast", "try_cast")) and not ok(base, "SELECT sum(v) FROM t") and not ok(base, "SELECT k, v FROM t GROUP BY k, v") and not ok(base, "SELECT k, sum(v) FROM t JOIN u GROUP BY k") and not ok("SELECT a FROM t", "SELECT * FROM t")
    assert guards.empty_is_null("SELECT 1 FROM t WHERE t.doc = '' AND x = ''", {"DOC"}) == "SELECT 1 FROM t WHERE (t.doc IS NULL OR t.doc = '') AND x = ''"
    assert guards.status_conflicts("SELECT count(*) AS Unpaid_Items FROM t WHERE paid = 'Y'") == ["unpaiditems"] and guards.status_conflicts("SELECT count(*) AS unpaid FROM t WHERE paid = 'N'") == [] and guards.status_conflicts("SELECT 1 AS open FROM t WHERE unpaid = 'Y'") == []
