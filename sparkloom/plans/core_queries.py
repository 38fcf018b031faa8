"""Queries of the reference's operators on the test tables, beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkloom import policy
from sparkloom.functions import scalars
from sparkloom.operators import cleaning, profiling, relate
from sparkloom.plans.registry import ORACLE, QUERIES, query, quoted  # noqa: F401
from sparkloom.session import table

# ---- scans, projections, set operations


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1995-07-01' AND l_discount BETWEEN 0.05 AND 0.07")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.where("l_shipdate >= date '1995-01-01' and l_shipdate < date '1995-07-01' and l_discount between 0.05 and 0.07").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topn_metric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region, NULL AS segment FROM nation UNION ALL BY NAME SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").selectExpr("n_nationkey key", "n_name name", "n_regionkey region")
    return n.unionByName(table(spark, d, "customer").selectExpr("c_custkey key", "c_name name", "c_mktsegment segment"), allowMissingColumns=True)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey custkey").subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_nationkey nationkey").intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 200")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey > 1000").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(200)


# ---- joins


@query("SELECT n_name AS nation, CAST(count(*) AS BIGINT) AS n_lines, round(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner_star(spark: SparkSession, d: str) -> DataFrame:
    # lines are summed by order before they meet the star: one row per order crosses the joins
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("r"))
    j = per_order.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), F.col("n").alias("n_lines"), F.round(F.col("r").cast("double"), 2).alias("revenue"))


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left_orphans(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"))
    return table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def join_semi_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity >= 49"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti_orphans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT e.event_id, (SELECT p.event_id FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'click' AND p.ts <= e.ts ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) AS last_click FROM events e WHERE e.event_type = 'purchase'")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the user's latest click at or before it, whatever the order of ids."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return relate.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "event_id").select("event_id", F.col("as_of").alias("last_click"))


# ---- aggregations


@query("SELECT o_orderpriority AS label, round(CAST(sum(o_totalprice) AS DOUBLE), 2) AS total, round(CAST(avg(o_totalprice) AS DOUBLE), 2) AS average, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def agg_sum_by_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.round(F.sum("o_totalprice").cast("double"), 2).alias("total"), F.round(F.avg("o_totalprice").cast("double"), 2).alias("average"), F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS BIGINT) AS year, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, round(CAST(sum(o_totalprice) AS DOUBLE), 2) AS total FROM orders GROUP BY 1, 2, 3")
def agg_by_period(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderdate")
    return table(spark, d, "orders").groupBy(F.date_format(o, "yyyy-MM").alias("month"), F.year(o).cast("long").alias("year"), scalars.quarter_label(o).alias("quarter")).agg(F.round(F.sum("o_totalprice").cast("double"), 2).alias("total"))


@query("SELECT l_returnflag, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders FROM lineitem GROUP BY 1 HAVING count(*) > 10")
def count_distinct_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("n_orders"), F.count(F.lit(1)).alias("n")).where("n > 10").drop("n")


@query("SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_region_nation(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"))
    j = per.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.sum("k").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(l_quantity) AS DOUBLE), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity").cast("double"), 2).alias("q"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("_gs_orders")
    return spark.sql("select o_orderstatus, o_orderpriority, count(*) n from _gs_orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")


@query("SELECT event_type, round(stddev_samp(value), 4) AS std, round(var_samp(value), 3) AS variance, round(median(value), 4) AS med, round(quantile_cont(value, 0.95), 4) AS p95, round(corr(value, CAST(user_id AS DOUBLE)), 5) AS corr FROM events GROUP BY 1")
def statistical_aggs(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, n, k: F.round(c, k).alias(n)
    return table(spark, d, "events").groupBy("event_type").agg(r(F.stddev_samp("value"), "std", 4), r(F.var_samp("value"), "variance", 3), r(F.median("value"), "med", 4), r(F.percentile("value", 0.95), "p95", 4), r(F.corr("value", F.col("user_id").cast("double")), "corr", 5))


@query("SELECT CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS \"A\", CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS \"N\", CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS \"R\", l_linestatus FROM lineitem GROUP BY l_linestatus")
def pivot_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT CASE WHEN age <= 30 THEN '0-30' WHEN age <= 60 THEN '31-60' WHEN age <= 90 THEN '61-90' ELSE '90+' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT date_diff('day', o_orderdate, DATE '1998-09-01') AS age FROM orders) GROUP BY 1")
def aging_buckets(spark: SparkSession, d: str) -> DataFrame:
    age = F.datediff(F.lit("1998-09-01").cast("date"), "o_orderdate")
    return table(spark, d, "orders").groupBy(F.when(age <= 30, "0-30").when(age <= 60, "31-60").when(age <= 90, "61-90").otherwise("90+").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# ---- windows


@query("SELECT label, month, round(total - lag(total) OVER (PARTITION BY label ORDER BY month), 2) AS delta, CAST(rank() OVER (PARTITION BY month ORDER BY total DESC) AS BIGINT) AS rank_in_month, round(sum(total) OVER (PARTITION BY label ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS running, round(total / sum(total) OVER (PARTITION BY month), 6) AS share FROM (SELECT o_orderpriority AS label, strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(o_totalprice) AS DOUBLE) AS total FROM orders GROUP BY 1, 2)")
def period_windows(spark: SparkSession, d: str) -> DataFrame:
    """Change against the period before, rank, running total and share of the period."""
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").cast("double").alias("total"))
    by_label, by_month = Window.partitionBy("label").orderBy("month"), Window.partitionBy("month")
    return t.select(
        "label", "month", F.round(F.col("total") - F.lag("total").over(by_label), 2).alias("delta"), F.rank().over(by_month.orderBy(F.desc("total"))).cast("long").alias("rank_in_month"),
        F.round(F.sum("total").over(by_label.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.round(F.col("total") / F.sum("total").over(by_month), 6).alias("share"),
    )


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders) WHERE rn <= 3")
def per_group_cap(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 3")


@query("SELECT round(CAST(sum(o_totalprice) AS DOUBLE), 2) AS kpi, round(CAST(max_by(t, m) - min_by(t, m) AS DOUBLE), 2) AS trend_delta FROM (SELECT o_totalprice, strftime(o_orderdate, '%Y-%m') AS m, sum(o_totalprice) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS t FROM orders)")
def kpi_and_trend(spark: SparkSession, d: str) -> DataFrame:
    monthly = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.sum("o_totalprice").alias("t"))
    return monthly.agg(F.round(F.sum("t").cast("double"), 2).alias("kpi"), F.round((F.max_by("t", "m") - F.min_by("t", "m")).cast("double"), 2).alias("trend_delta"))


@query("WITH t AS (SELECT n_name AS label, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT CASE WHEN count(*) = 1 THEN max(label) END AS top_label FROM t WHERE total = (SELECT max(total) FROM t)")
def top_contributor(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    t = per.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("t").alias("total")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    best = t.groupBy("total").agg(F.count(F.lit(1)).alias("n"), F.max("n_name").alias("label")).orderBy(F.desc("total")).limit(1)
    return best.select(F.when(F.col("n") == 1, F.col("label")).alias("top_label"))


# ---- profiling


def _profile_sql(name: str, cols: list[tuple[str, str, str]]) -> str:
    one = "SELECT '{c}' AS column_name, '{t}' AS dtype, CASE WHEN '{s}' = 'text' AND count({c}) > 0 AND count(DISTINCT {c}) / count({c}) < 0.05 AND count(DISTINCT {c}) < 5000 THEN 'category' ELSE '{s}' END AS semantic_type, CAST(count(*) AS BIGINT) AS n_rows, round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM " + name
    return " UNION ALL ".join(one.format(c=c, t=t, s=s) for c, t, s in cols)


@query(_profile_sql("documents", [("doc_id", "bigint", "measure"), ("lang", "string", "text"), ("source", "string", "text"), ("n_chars", "bigint", "measure"), ("tenant_id", "string", "text"), ("doc_date", "date", "date")]))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiling.column_profile(table(spark, d, "documents"), ["doc_id", "lang", "source", "n_chars", "tenant_id", "doc_date"])


@query("SELECT column_name, value, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n_rows DESC, value) AS r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n_rows FROM documents WHERE {c} IS NOT NULL GROUP BY 2" for c in ("lang", "source", "tenant_id")) + ")) WHERE r <= 20")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return profiling.value_counts(table(spark, d, "documents"), ["lang", "source", "tenant_id"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, round(CAST(min({c}) AS DOUBLE), 4) AS min_value, round(CAST(max({c}) AS DOUBLE), 4) AS max_value, round(avg(CAST({c} AS DOUBLE)), 4) AS mean_value, round(sum(CAST({c} AS DOUBLE)), 4) AS sum_value, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std_value FROM files" for c in ("size", "upload_duration_secs")))
def sample_stats(spark: SparkSession, d: str) -> DataFrame:
    return profiling.sample_stats(table(spark, d, "files"), ["size", "upload_duration_secs"])


@query("SELECT CAST(source AS VARCHAR) AS dimension, round(sum(CAST(n_chars AS DOUBLE)), 4) AS total, round(avg(CAST(n_chars AS DOUBLE)), 4) AS average, CAST(count(*) AS BIGINT) AS n_rows FROM documents GROUP BY 1 ORDER BY total DESC, dimension LIMIT 15")
def cross_tab(spark: SparkSession, d: str) -> DataFrame:
    return profiling.cross_tab(table(spark, d, "documents"), "source", "n_chars")


# ---- cleaning

_CLEAN = "nullif(trim(regexp_replace(regexp_replace({0}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}\\x{{AD}}]', '', 'g'), '[\\s\\x{{A0}}]+', ' ', 'g')), '')"


@query("SELECT doc_id, CASE WHEN lower(trim(l)) NOT IN (" + quoted(policy.NULL_TOKENS) + ") THEN l END AS lang, CASE WHEN lower(trim(s)) NOT IN (" + quoted(policy.NULL_TOKENS) + ") THEN s END AS source FROM (SELECT doc_id, " + _CLEAN.format("lang") + " AS l, " + _CLEAN.format("source") + " AS s FROM documents)")
def clean_strings(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_strings(table(spark, d, "documents").select("doc_id", "lang", "source"))


@query("SELECT reason, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT CASE WHEN coalesce(trim(name), '') = '' AND coalesce(trim(normalized_value), '') = '' THEN 'all_empty' WHEN regexp_matches(lower(name), '^\\s*(" + "|".join(policy.GARBAGE_PATTERNS).replace("'", "''") + ")(?:\\b|$)') THEN 'garbage_keyword' WHEN (coalesce(trim(name), '') <> '' OR coalesce(trim(normalized_value), '') <> '') AND (coalesce(trim(name), '') = '' OR regexp_full_match(trim(name), '[-=*_~\\s|+]+')) AND (coalesce(trim(normalized_value), '') = '' OR regexp_full_match(trim(normalized_value), '[-=*_~\\s|+]+')) THEN 'separator' END AS reason FROM entities) WHERE reason IS NOT NULL GROUP BY 1")
def quarantine_reasons(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.quarantine_summary(cleaning.judge_rows(table(spark, d, "entities").select("name", "normalized_value")))


@query("SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS amount FROM customer")
def numbers_from_text(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written as text with a currency sign and thousands marks, read back."""
    written = F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(F.col("c_acctbal")), 2))
    fixed = F.regexp_replace(written, r"^-\$", r"\$-")
    return table(spark, d, "customer").select("c_custkey", scalars.number_of(fixed).alias("amount"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def dates_from_text(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in three ways and as spreadsheet serials, read back."""
    c = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    serial = F.datediff(c, F.lit(policy.SERIAL_EPOCH).cast("date")).cast("string")
    written = F.when(k == 0, F.date_format(c, "yyyy-MM-dd")).when(k == 1, F.date_format(c, "yyyy/MM/dd")).when(k == 2, F.date_format(c, "dd MMM yyyy")).otherwise(serial)
    return table(spark, d, "orders").select("o_orderkey", scalars.date_of(written).alias("day"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_type").dropDuplicates()
