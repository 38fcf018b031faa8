from datetime import date

import pytest

from sparkloom.plans import guards, planner, temporal
from sparkloom.plans.plan_queries import GUARDED

T = date(2024, 5, 31)


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(1, 10, 5.0, "x"), (2, 10, 7.0, "y"), (3, 11, None, "1")], "o_id int, c_id int, price double, amount_limit string").createOrReplaceTempView("o")
    spark.createDataFrame([(10, "a"), (11, "b")], "id int, name string").createOrReplaceTempView("c")
    return spark


def test_limit_is_read_from_the_plan(views):
    assert not guards.has_limit(views, "SELECT amount_limit FROM o")
    assert not guards.has_limit(views, "SELECT * FROM (SELECT * FROM o LIMIT 1) t")
    assert guards.has_limit(views, "WITH t AS (SELECT * FROM o) SELECT * FROM t LIMIT 5")


def test_run_sql(views):
    out = guards.run_sql(views, "SELECT c.name, sum(o.price) AS s FROM o JOIN c ON o.c_id = c.id GROUP BY 1 ORDER BY 1")
    assert out["rows"] == [{"name": "a", "s": 12.0}, {"name": "b", "s": None}] and out["total"] == 2
    out = guards.run_sql(views, "SELECT sum(cast(amount_limit AS int)) AS s FROM o")
    assert out["rows"] == [{"s": 1}] and "try_cast" in out["sql"]
    out = guards.run_sql(views, "SELECT c_id, count(*) AS n FROM o ORDER BY c_id")
    assert out["rows"] == [{"c_id": 10, "n": 2}, {"c_id": 11, "n": 1}]
    assert guards.run_sql(views, "DELETE FROM o")["reasons"] == ["not a read-only query"]
    assert guards.run_sql(views, "SELEC 1")["reasons"] == ["cannot be parsed"]
    assert guards.check(views, "SELECT 1 FROM o WHERE price > " + "1" * 9000).reasons == ["statement too long"]


def test_approved_joins(views):
    sql = "SELECT count(*) n FROM o JOIN c ON o.c_id = c.id"
    assert guards.check(views, sql, {(("o", "c_id"), ("c", "id"))}).ok
    assert guards.check(views, sql, set()).reasons == ["join not approved: c.id = o.c_id"]


def test_fan_out(views):
    assert guards.check(views, "SELECT sum(o.price) a, sum(c.id) b FROM o JOIN c ON o.c_id = c.id").reasons[0].startswith("fan-out")
    assert guards.check(views, "SELECT sum(p) a, avg(q) b FROM (SELECT o.price * 2 p, c.id + 1 q FROM o JOIN c ON o.c_id = c.id) t").reasons[0].startswith("fan-out")
    assert guards.check(views, "SELECT sum(o.price) a, max(c.id) b FROM o JOIN c ON o.c_id = c.id").ok
    assert len(GUARDED) >= 14


def test_dialect():
    assert guards.to_spark_sql("SELECT date_diff('day', a, b), group_concat(x), 'group_concat(x)' FROM t") == "SELECT date_diff(DAY, a, b), listagg(x, ','), 'group_concat(x)' FROM t"
    assert guards.to_spark_sql("SELECT * FROM read_parquet('a/b.parquet')") == "SELECT * FROM parquet.`a/b.parquet`"


def test_periods():
    p = lambda s: temporal.parse_period(s, T)
    assert p("last 3 months") == (date(2024, 2, 1), T) and p("last 1 year") == (date(2023, 5, 31), T)
    assert temporal.parse_period("last 1 month", date(2024, 3, 31)) == (date(2024, 2, 1), date(2024, 3, 31))
    assert p("FY24 Q4") == (date(2024, 1, 1), date(2024, 3, 31)) and p("2024 Q1") == (date(2024, 1, 1), date(2024, 3, 31))
    assert temporal.parse_window("last 1 month", T, date(2024, 3, 31)) == (date(2024, 2, 29), date(2024, 3, 31))
    assert temporal.parse_window("this month", T)[1] == T and p("nothing here") == (None, None)
    assert temporal.overlaps((None, T), (T, None)) and not temporal.overlaps((date(2025, 1, 1), None), (None, T))


def test_intent():
    i = planner.parse_intent("Top 5 total revenue by cost center quarterly in 2023", T)
    assert i.aggregations == ["SUM"] and i.labels == ["cost center"] and i.period == "quarter" and i.top_n == 5 and i.window == (date(2023, 1, 1), date(2023, 12, 31))
    assert planner.parse_intent("how many orders per region", T).aggregations == ["COUNT"]
    assert planner.parse_intent("list all vendors", T).aggregations == ["RAW"]
    with pytest.raises(ValueError):
        planner.plan("why did sales fall", {}, [], [], T)


def test_the_measure_is_the_label_the_question_names(spark):
    t = spark.createDataFrame([("x", 1.0, 10.0, 100.0)], "kind string, total_price double, extended_price double, weight double")
    roles = [planner.Column("t", "total_price", "additive_measure", "total price"), planner.Column("t", "extended_price", "additive_measure", "extended price"), planner.Column("t", "weight", "additive_measure", "weight"), planner.Column("t", "kind", "attribute", "kind")]
    ask = lambda q: planner.plan(q, {"t": t}, r, [], T).first()["value"]
    for r in (roles, roles[::-1]):
        assert ask("total extended price by kind") == 10.0 and ask("total price by kind") == 1.0 and ask("sum of total price by kind") == 1.0
        assert ask("total weight by kind") == 100.0 and ask("average extended price by kind") == 10.0 and ask("highest total price by kind") == 1.0
        with pytest.raises(ValueError):
            ask("total height by kind")
