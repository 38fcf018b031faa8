"""Dashboards: tie-out, conformed dimensions, shares and windows of widgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom import policy


def tie_out(parts: DataFrame, wholes: DataFrame, tolerance: float = policy.TIEOUT_TOLERANCE) -> DataFrame:
    """parts and wholes(measure, table_name, value): measures whose parts sum to more than the largest whole, beyond the tolerance."""
    p = parts.groupBy("measure", "table_name").agg(F.sum("value").alias("parts"))
    w = wholes.groupBy("measure", "table_name").agg(F.max("value").alias("whole"))
    return p.join(w, ["measure", "table_name"]).withColumn("double_counted", F.col("parts") > F.col("whole") * (1 + tolerance))


def conformed_dimensions(members: DataFrame, max_members: int = 50, floor: float = policy.JACCARD_FLOOR) -> DataFrame:
    """members(role, table_name, member): roles in at least two tables whose complete small domains agree, by the least pairwise Jaccard share.

    Domains above max_members are no dimension, so a set is bounded; pairs are formed between the tables of a role only.
    """
    m = members.select("role", "table_name", F.lower(F.trim("member")).alias("m")).where("m <> ''").distinct()
    sizes = m.groupBy("role", "table_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_members)
    sets = m.join(sizes.select("role", "table_name"), ["role", "table_name"], "left_semi").groupBy("role", "table_name").agg(F.collect_set("m").alias("s"))
    a, b = sets.select("role", F.col("table_name").alias("ta"), F.col("s").alias("sa")), sets.select("role", F.col("table_name").alias("tb"), F.col("s").alias("sb"))
    pair = a.join(b, "role").where("ta < tb").select("role", "ta", "tb", (F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).alias("j"))
    return pair.groupBy("role").agg(F.round(F.min("j"), 6).alias("min_jaccard"), (F.array_size(F.array_distinct(F.flatten(F.collect_list(F.array("ta", "tb")))))).cast("long").alias("n_tables")).where(F.col("min_jaccard") >= floor)


def unsafe_pairs(used: DataFrame, edges: DataFrame) -> DataFrame:
    """used(widget, table_name): pairs of a widget's tables without an approved edge of enough overlap that is not many to many; a missing fact is unsafe."""
    a, b = used.select("widget", F.col("table_name").alias("ta")), used.select("widget", F.col("table_name").alias("tb"))
    pairs = a.join(b, "widget").where("ta < tb").distinct()
    safe = edges.where((F.col("overlap") >= policy.EDGE_MIN_OVERLAP) & (F.coalesce("relationship_type", F.lit("many_to_many")) != "many_to_many")).select(F.least("file_a", "file_b").alias("ta"), F.greatest("file_a", "file_b").alias("tb")).distinct()
    return pairs.join(safe, ["ta", "tb"], "left_anti").select("widget", "ta", "tb")


def share_of_total(df: DataFrame, label: str, measure: str, top: int = 10) -> DataFrame:
    """label, value, share: the top groups and their share of the whole."""
    per = df.groupBy(F.col(label).alias("label")).agg(F.sum(F.col(measure).cast("double")).alias("value"))
    whole = per.agg(F.sum("value").alias("whole"))
    return per.join(F.broadcast(whole)).select("label", F.round("value", 2).alias("value"), F.round(F.try_divide("value", "whole"), 6).alias("share")).orderBy(F.desc("value"), "label").limit(top)  # one row is broadcast
