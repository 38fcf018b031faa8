"""Profiles of whole tables, never of a first batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sparkloom import policy

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in NUMBERS or t.startswith("decimal")]


def semantic_type(dtype: str) -> str:
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return "date"
    return "measure" if dtype in NUMBERS or dtype.startswith("decimal") else "text"


def unpivot_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, value (as text): one row per cell."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])).alias("x")).select("x.*")


def column_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column_name, dtype, semantic_type, n_rows, null_pct (1 dp), distinct_count, min_value, max_value (as text, in the column's own order).

    One row per column from one aggregation; a text column of few distinct values is a category.
    """
    cols = cols or [n for n, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        q = F.col(f"`{c}`")
        aggs += [F.count(q).alias(f"c{i}"), F.count_distinct(q).alias(f"d{i}"), F.min(q).cast("string").alias(f"lo{i}"), F.max(q).cast("string").alias(f"hi{i}")]
    row = df.agg(*aggs)
    parts = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
            F.when((F.lit(semantic_type(types[c])) == "text") & (F.col(f"c{i}") > 0) & (F.col(f"d{i}") / F.col(f"c{i}") < policy.CATEGORY_SHARE) & (F.col(f"d{i}") < policy.CATEGORY_MAX), "category").otherwise(semantic_type(types[c])).alias("semantic_type"),
            F.col("n").alias("n_rows"), F.round(F.try_divide((F.col("n") - F.col(f"c{i}")) * 100.0, F.col("n")), 1).alias("null_pct"), F.col(f"d{i}").alias("distinct_count"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"),
        )
        for i, c in enumerate(cols)
    ]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def value_counts(df: DataFrame, cols: list[str], top: int = 20) -> DataFrame:
    """column_name, value, n_rows: the top values of each column, ties by value. One shuffle for all columns."""
    counts = unpivot_text(df, cols).where("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n_rows"), "value")
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def sample_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column_name, n_nulls, n_unique, min_value, max_value, mean_value, sum_value, std_value (all to 4 dp) of numeric columns; not-a-number and infinity count as null."""
    cols = cols or numeric_columns(df)
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols]))
    v = F.when(~F.isnan("x.v") & (F.abs("x.v") != float("inf")), F.col("x.v"))
    r = lambda c: F.round(c, 4)
    return df.select(cell.alias("x")).select("x.column_name", v.alias("v")).groupBy("column_name").agg(
        (F.count(F.lit(1)) - F.count("v")).alias("n_nulls"), F.count_distinct("v").alias("n_unique"), r(F.min("v")).alias("min_value"), r(F.max("v")).alias("max_value"), r(F.avg("v")).alias("mean_value"), r(F.sum("v")).alias("sum_value"), r(F.stddev_samp("v")).alias("std_value"),
    )


def cross_tab(df: DataFrame, dimension: str, metric: str, top: int = 15) -> DataFrame:
    """dimension, total, average, n_rows of the top groups by total, ties by name."""
    return (
        df.groupBy(F.col(dimension).cast("string").alias("dimension"))
        .agg(F.round(F.sum(F.col(metric).cast("double")), 4).alias("total"), F.round(F.avg(F.col(metric).cast("double")), 4).alias("average"), F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("total"), "dimension").limit(top)
    )


def result_shape(df: DataFrame) -> list[dict]:
    """Kind, cardinality and null share (4 dp) of a small result's columns: temporal by name or type, measure, category or text."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(f"`{c}`").cast("string")).alias(f"d{i}") for i, c in enumerate(df.columns)], *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    out = []
    for i, (c, t) in enumerate(df.dtypes):
        temporal = semantic_type(t) == "date" or any(h in c.lower() for h in ("date", "month", "year", "quarter", "week", "day", "period", "time"))
        kind = "temporal" if temporal else "measure" if semantic_type(t) == "measure" else "category" if row[f"d{i}"] <= 50 else "text"
        out.append({"name": c, "kind": kind, "cardinality": row[f"d{i}"], "null_ratio": round(1 - row[f"c{i}"] / row["n"], 4) if row["n"] else 0.0})
    return out
