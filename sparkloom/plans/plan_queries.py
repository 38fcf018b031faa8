"""Queries of guards, dates, the question planner, sources and event windows on the test tables, beside their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.plans import guards, planner, temporal
from sparkloom.plans.registry import query, quoted
from sparkloom.streaming import windows
from sparkloom.session import table

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
TODAY = date(2024, 5, 15)


def _views(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    tables = {t: table(spark, d, t) for t in STAR}
    for t, df in tables.items():
        df.createOrReplaceTempView(t)
    return tables


GUARDED = {
    "plain join": ("SELECT c_mktsegment, sum(o_totalprice) s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", True),
    "comma join with equality": ("SELECT count(*) n FROM orders, customer WHERE o_custkey = c_custkey", True),
    "cartesian": ("SELECT count(*) n FROM orders, customer", False),
    "cross join": ("SELECT 1 x FROM nation CROSS JOIN region", False),
    "drop": ("DROP TABLE orders", False),
    "insert": ("INSERT INTO orders SELECT * FROM orders", False),
    "two statements": ("SELECT 1; SELECT 2", False),
    "word in a literal": ("SELECT 'drop; table' x", True),
    "fan-out": ("SELECT sum(o_totalprice) a, sum(l_quantity) b FROM orders JOIN lineitem ON o_orderkey = l_orderkey", False),
    "aggregated first": ("SELECT sum(t) a FROM (SELECT o_custkey, sum(o_totalprice) t FROM orders GROUP BY 1) o JOIN customer ON o_custkey = c_custkey", True),
    "unknown column": ("SELECT no_such FROM orders", False),
    "set operation": ("SELECT n_name FROM nation UNION ALL SELECT r_name FROM region", False),
    "cte": ("WITH t AS (SELECT o_custkey FROM orders) SELECT count(*) n FROM t", True),
    "six joins": ("SELECT 1 x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey", False),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"({quoted([k])}, {str(ok).upper()})" for k, (_, ok) in GUARDED.items()) + ") t(name, ok)")
def guard_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Which statements the guards let run."""
    _views(spark, d)
    return spark.createDataFrame([(k, guards.check(spark, q).ok) for k, (q, _) in GUARDED.items()], "name string, ok boolean")


@query("SELECT CAST(max(date_diff('day', o_orderdate, TIMESTAMP '2000-01-01')) AS BIGINT) AS days, CAST(count(strptime('19-Mar-2018', '%d-%b-%Y')) AS BIGINT) AS parsed FROM orders")
def dialect_shim(spark: SparkSession, d: str) -> DataFrame:
    """A statement in another dialect, written over and run."""
    _views(spark, d)
    return spark.sql(guards.to_spark_sql("SELECT max(date_diff('day', o_orderdate, TIMESTAMP '2000-01-01')) AS days, count(strptime('19-Mar-2018', '%d-%b-%Y')) AS parsed FROM orders"))


@query("SELECT * FROM (VALUES (TRUE, 'same plan'), (FALSE, 'other plan')) t(equal, name)")
def plan_signature(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of a query, of the same with its conditions in another order, and of another."""
    t = _views(spark, d)["orders"]
    a = guards.signature(t.where("o_custkey > 5 and o_orderkey > 7").select("o_orderkey"))
    b = guards.signature(t.where("o_orderkey > 7 and o_custkey > 5").select("o_orderkey"))
    c = guards.signature(t.where("o_orderkey > 8 and o_custkey > 5").select("o_orderkey"))
    return spark.createDataFrame([(a == b, "same plan"), (a == c, "other plan")], "equal boolean, name string")


PERIODS = {
    "last 30 days": ("2024-04-15", "2024-05-15"), "last 3 months": ("2024-02-01", "2024-05-15"), "this month": ("2024-05-01", "2024-05-31"), "last month": ("2024-04-01", "2024-04-30"), "Q2 2023": ("2023-04-01", "2023-06-30"),
    "FY2025 Q1": ("2024-04-01", "2024-06-30"), "FY2024": ("2023-04-01", "2024-03-31"), "March 2023": ("2023-03-01", "2023-03-31"), "year to date": ("2024-01-01", "2024-05-15"), "in 2022": ("2022-01-01", "2022-12-31"),
    "between 2021 and 2022": ("2021-01-01", "2022-12-31"), "yesterday": ("2024-05-14", "2024-05-14"), "last week": ("2024-05-06", "2024-05-12"), "since 2023": ("2023-01-01", "2024-05-15"), "last year": ("2023-01-01", "2023-12-31"), "no period": (None, None),
}


@query("SELECT name, CAST(a AS DATE) AS date_from, CAST(b AS DATE) AS date_to FROM (VALUES " + ", ".join(f"({quoted([k])}, {quoted([a]) if a else 'NULL'}, {quoted([b]) if b else 'NULL'})" for k, (a, b) in PERIODS.items()) + ") t(name, a, b)")
def relative_periods(spark: SparkSession, d: str) -> DataFrame:
    """Named periods as date ranges, seen from a fixed day."""
    return spark.createDataFrame([(k, *temporal.parse_period("sales " + k, TODAY)) for k in PERIODS], "name string, date_from date, date_to date")


ROLES = [
    planner.Column("orders", "o_totalprice", "additive_measure", "total price"), planner.Column("orders", "o_orderdate", "date", "order date"), planner.Column("orders", "o_orderpriority", "attribute", "order priority"),
    planner.Column("lineitem", "l_extendedprice", "additive_measure", "extended price"), planner.Column("lineitem", "l_quantity", "additive_measure", "quantity"), planner.Column("lineitem", "l_discount", "non_additive_measure", "discount"), planner.Column("customer", "c_mktsegment", "attribute", "segment"),
]
JOINS = [("lineitem", "l_orderkey", "orders", "o_orderkey", 0.98), ("orders", "o_custkey", "customer", "c_custkey", 0.95)]


@query("SELECT o_orderpriority AS order_priority, strftime(o_orderdate, '%Y-%m') AS period, round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS value FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 ORDER BY value DESC LIMIT 10")
def question_top_priority_months(spark: SparkSession, d: str) -> DataFrame:
    """top 10 total extended price by order priority monthly"""
    df = planner.plan("top 10 total extended price by order priority monthly", _views(spark, d), ROLES, JOINS, TODAY)
    return df.withColumn("value", F.round("value", 2))


@query("SELECT c_mktsegment AS segment, round(avg(CAST(o_totalprice AS DOUBLE)), 2) AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY 1")
def question_average_by_segment(spark: SparkSession, d: str) -> DataFrame:
    """average total price by segment in 1996"""
    df = planner.plan("average total price by segment in 1996", _views(spark, d), ROLES, JOINS, TODAY)
    return df.withColumn("value", F.round("value", 2))


@query("SELECT o_orderpriority AS order_priority, round(sum(CAST(l_quantity AS DOUBLE)), 2) AS value FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-04-01' AND DATE '1997-06-30' GROUP BY 1")
def question_sum_by_label(spark: SparkSession, d: str) -> DataFrame:
    """total quantity by order priority in Q2 1997"""
    return planner.plan("total quantity by order priority in Q2 1997", _views(spark, d), ROLES, JOINS, TODAY).withColumn("value", F.round("value", 2))


@query("SELECT strftime(o_orderdate, '%Y') AS period, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1")
def question_count_by_year(spark: SparkSession, d: str) -> DataFrame:
    """how many orders per year"""
    return planner.plan("how many orders per year", _views(spark, d), [c for c in ROLES if c.table == "orders"], JOINS, TODAY).withColumn("value", F.col("value").cast("double"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = windows.tumbling(table(spark, d, "events"), "ts", ["event_type"], "value", "1 day")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, CAST(count(*) AS BIGINT) AS n_events FROM s GROUP BY user_id, n")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = windows.sessions(table(spark, d, "events"), "ts", "user_id", "2 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k is not null")


@query("SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(tag_labels) AS tag FROM doc_cards) GROUP BY 1")
def array_unnest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_cards").select(F.explode("tag_labels").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
