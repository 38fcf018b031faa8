"""Joins found from values: key registry, fingerprint overlap, confidence, approval, masters.

Column sets are compared through signatures: a value's set of columns is formed once, equal sets are counted, and pairs are read off the
distinct sets. So a value that stands in many columns costs one row, not a row for each pair of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom import policy
from sparkloom.functions.scalars import fingerprint
from sparkloom.session import durable


def column_values(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """file_name, column_name, value: one row per cell of the columns (table, column); one scan of each table."""
    out = None
    for t in dict.fromkeys(t for t, _ in columns):
        cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for u, c in columns if u == t]
        one = tables[t].select(F.lit(t).alias("file_name"), F.explode(F.array(*cells)).alias("x")).select("file_name", "x.*")
        out = one if out is None else out.unionByName(one)
    return out


def hashed_values(values: DataFrame) -> DataFrame:
    """file_name, column_name, fp, n: each column's distinct normalised values with their rows; null for cells without a value. The one pass both the registry and the overlap need."""
    raw = values.groupBy("file_name", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))  # each value is normalised and hashed once
    return raw.withColumn("fp", fingerprint(F.col("value"))).groupBy("file_name", "column_name", "fp").agg(F.sum("n").alias("n"))


def key_registry(hashed: DataFrame) -> DataFrame:
    """file_name, column_name, n_rows, cardinality, unique_rate, null_rate, key_kind (pk, fk or null) over all rows, from ``hashed_values``."""
    reg = hashed.groupBy("file_name", "column_name").agg(F.sum("n").alias("n_rows"), F.count("fp").alias("cardinality"), F.coalesce(F.sum(F.when(F.col("fp").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
    unique = F.coalesce(F.try_divide("cardinality", F.col("n_rows") - F.col("nulls")), F.lit(0.0))
    null = F.coalesce(F.try_divide("nulls", "n_rows"), F.lit(1.0))
    return reg.select("file_name", "column_name", "n_rows", "cardinality", unique.alias("unique_rate"), null.alias("null_rate")).withColumn("key_kind", key_kind(F.lit(None).cast("string"), F.col("unique_rate"), F.col("null_rate")))


def key_kind(role: Column, unique: Column, null: Column) -> Column:
    """A key role is taken unless too null or nearly constant; without a role only clear cardinalities count."""
    named = role.rlike("^custom:(entity_key|reference_key):")
    by_role = F.when((null <= policy.ROLE_MAX_NULL) & (unique > policy.ROLE_MIN_UNIQUE), F.when((unique >= policy.PK_UNIQUE) & (null <= policy.PK_NULL), "pk").otherwise("fk"))
    generic = F.when((null <= policy.PK_NULL) & (unique >= policy.GENERIC_PK_UNIQUE), "pk").when((null <= policy.FK_MAX_NULL) & unique.between(policy.FK_MIN_UNIQUE, policy.FK_MAX_UNIQUE), "fk")
    return F.when(F.coalesce(named, F.lit(False)), by_role).otherwise(generic)


def fingerprint_overlap(hashed: DataFrame) -> DataFrame:
    """file_a, column_a, file_b, column_b, n_shared, overlap (of the smaller set), cardinality_a, cardinality_b of columns of different files that share values, from ``hashed_values``."""
    fps = hashed.where("fp is not null").select(F.concat_ws("\u0001", "file_name", "column_name").alias("p"), "fp")
    signatures = durable(fps.groupBy("fp").agg(F.array_sort(F.collect_set("p")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")))  # one row per distinct set of columns
    sizes = signatures.select(F.explode("s").alias("p"), "n").groupBy("p").agg(F.sum("n").alias("size"))
    sets = signatures.where(F.size("s") > 1)
    first = sets.select("s", "n", F.posexplode("s").alias("i", "pa"))
    pairs = first.select("pa", "n", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("pb")).where(F.split("pa", "\u0001")[0] != F.split("pb", "\u0001")[0])
    shared = pairs.groupBy("pa", "pb").agg(F.sum("n").alias("n_shared"))
    both = shared.join(sizes.select(F.col("p").alias("pa"), F.col("size").alias("cardinality_a")), "pa").join(sizes.select(F.col("p").alias("pb"), F.col("size").alias("cardinality_b")), "pb")
    a, b = F.split("pa", "\u0001"), F.split("pb", "\u0001")
    overlap = F.col("n_shared") / F.least("cardinality_a", "cardinality_b")
    return both.select(a[0].alias("file_a"), a[1].alias("column_a"), b[0].alias("file_b"), b[1].alias("column_b"), "n_shared", overlap.alias("overlap"), "cardinality_a", "cardinality_b").where((F.col("n_shared") >= policy.MIN_OVERLAP_COUNT) & (F.col("overlap") >= policy.MIN_OVERLAP))


def join_confidence(overlap: Column, cardinality: Column) -> Column:
    """A blend of overlap and log-scaled cardinality, within fixed bounds."""
    size = F.least(F.lit(1.0), F.log10(F.greatest(cardinality, F.lit(1))) / F.log10(F.lit(policy.CARDINALITY_REFERENCE)))
    raw = policy.OVERLAP_WEIGHT * F.greatest(F.lit(0.0), F.least(overlap, F.lit(1.0))) + policy.CARDINALITY_WEIGHT * size
    return F.least(F.lit(policy.CONFIDENCE_MAX), F.greatest(F.lit(policy.CONFIDENCE_MIN), raw))


def cardinality_of(kind_a: Column, kind_b: Column) -> Column:
    return F.when((kind_a == "pk") & (kind_b == "pk"), "one_to_one").when(kind_a == "pk", "one_to_many").when(kind_b == "pk", "many_to_one").otherwise("many_to_many")


def edges(overlap: DataFrame, registry: DataFrame) -> DataFrame:
    """Edges that pass the overlap and cardinality gates, with join type, confidence and cardinality; the best of repeated detections."""
    least = F.least("cardinality_a", "cardinality_b")
    kept = overlap.where((F.col("overlap") >= policy.EDGE_MIN_OVERLAP) & (least >= policy.EDGE_MIN_CARDINALITY)).withColumn("confidence", join_confidence(F.col("overlap"), least))
    kind = registry.select("file_name", "column_name", "key_kind")
    a = kind.select(F.col("file_name").alias("file_a"), F.col("column_name").alias("column_a"), F.col("key_kind").alias("kind_a"))
    b = kind.select(F.col("file_name").alias("file_b"), F.col("column_name").alias("column_b"), F.col("key_kind").alias("kind_b"))
    full = kept.join(a, ["file_a", "column_a"], "left").join(b, ["file_b", "column_b"], "left")
    return full.select("file_a", "column_a", "file_b", "column_b", "overlap", "confidence", "cardinality_a", "cardinality_b", F.when(F.col("overlap") >= policy.INNER_OVERLAP, "INNER").otherwise("LEFT").alias("join_type"), cardinality_of(F.col("kind_a"), F.col("kind_b")).alias("relationship_type"))


def ubiquity(file_columns: DataFrame) -> DataFrame:
    """container_id, column_name, ubiquity: the share of a container's files that carry the column."""
    total = file_columns.groupBy("container_id").agg(F.count_distinct("file_id").alias("files"))
    per = file_columns.groupBy("container_id", "column_name").agg(F.count_distinct("file_id").alias("n"))
    return per.join(total, "container_id").select("container_id", "column_name", (F.col("n") / F.col("files")).alias("ubiquity"))


def approval(same_key: Column, ubiquity: Column, overlap: Column, card_a: Column, card_b: Column, confidence: Column, relationship: Column, risky_role: Column, companion: Column) -> Column:
    """STRUCT<status, reason>. A key of one name joins on its values alone, unless it is everywhere, tiny, weak or a copy; others need a key side and confidence."""
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    wide, small, weak = ubiquity > policy.UBIQUITY_CEILING, F.least(card_a, card_b) < policy.EDGE_MIN_CARDINALITY, overlap < policy.EDGE_MIN_OVERLAP
    copy = same_key & (overlap >= policy.CLONE_OVERLAP) & (card_a == card_b)
    no = lambda reason: say("candidate", reason)
    role = F.when(companion, no("single-column reference key needs composite join approval before use")).otherwise(no("role alone is not a safe business join key"))
    many = F.when(companion, no("many-to-many join needs composite grain approval before use")).otherwise(no("many-to-many join can duplicate rows unless a grain rule approves it"))
    return (
        F.when(~same_key & risky_role, role)
        .when(wide, no("ubiquitous/audit column, not a business key")).when(small, no("cardinality too low to be a key")).when(weak, no("insufficient value overlap"))
        .when(copy, no("templated/copied column, not a referential key")).when(same_key, say("approved", None))
        .when(relationship == "many_to_many", many)
        .when((confidence >= policy.APPROVED_CONFIDENCE) & (overlap >= policy.MIN_OVERLAP), say("approved", None))
        .otherwise(no("needs stronger confidence or business approval"))
    )


def elect_masters(candidates: DataFrame) -> DataFrame:
    """The best file of each entity: candidates(entity, file_name, unique_rate, null_rate, has_key, measure_share, inbound_edges, ubiquity); ubiquitous keys lose."""
    edge = F.col("inbound_edges") / (F.col("inbound_edges") + policy.MASTER_SATURATION)
    score = policy.MASTER_UNIQUE * F.col("unique_rate") + policy.MASTER_NONNULL * (1 - F.col("null_rate")) + policy.MASTER_KEY * F.col("has_key").cast("double") + policy.MASTER_ATTRIBUTES * (1 - F.col("measure_share")) + policy.MASTER_EDGES * edge
    w = Window.partitionBy("entity").orderBy(F.col("ubiquity") > policy.UBIQUITY_CEILING, F.desc("score"), F.desc("file_name"))
    return candidates.withColumn("score", score).withColumn("r", F.row_number().over(w)).where("r = 1").select("entity", "file_name", "score")


def reconcile_values(samples: DataFrame, masters: DataFrame, min_share: float = 0.5, min_count: int = 3, min_confidence: float = 0.7) -> DataFrame:
    """samples(subject, value) against masters(master, confidence, value): each subject's best master or none. The share is of the subject's values."""
    left = samples.select("subject", fingerprint(F.col("value")).alias("fp")).where("fp is not null").distinct()
    right = masters.select("master", "confidence", fingerprint(F.col("value")).alias("fp")).where("fp is not null").distinct()
    size = left.groupBy("subject").agg(F.count(F.lit(1)).alias("size"))
    hit = left.join(right, "fp").groupBy("subject", "master").agg(F.count_distinct("fp").alias("n"), F.max("confidence").alias("confidence")).join(size, "subject").withColumn("share", F.col("n") / F.col("size"))
    good = hit.where((F.col("share") >= min_share) & (F.col("n") >= min_count) & (F.col("confidence") >= min_confidence))
    w = Window.partitionBy("subject").orderBy(F.desc("confidence"), F.desc("share"), F.desc("n"), "master")
    best = good.withColumn("r", F.row_number().over(w)).where("r = 1").select("subject", "master", "share", "n")
    return size.select("subject").join(best, "subject", "left").withColumn("outcome", F.when(F.col("master").isNull(), "REFUSED").otherwise("LINKED"))


def reconcile_grain(facts: DataFrame, totals: DataFrame, tolerance: float = policy.GRAIN_TOLERANCE) -> DataFrame:
    """facts(period, unit, rate, volume) against totals(period, unit, total): whether rate times volume gives the total within the tolerance."""
    key = lambda df: df.withColumn("k_period", F.lower(F.trim("period"))).withColumn("k_unit", F.lower(F.trim("unit")))
    j = key(facts).select("k_period", "k_unit", (F.col("rate") * F.col("volume")).alias("made")).join(key(totals).select("k_period", "k_unit", "total"), ["k_period", "k_unit"])
    gap = F.abs(F.col("made") - F.col("total")) / F.greatest(F.lit(1.0), F.abs("total"))
    return j.select(F.col("k_period").alias("period"), F.col("k_unit").alias("unit"), F.round(gap, 6).alias("gap"), (gap <= tolerance).alias("ties"))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width_days: int = 32) -> DataFrame:
    """Rows of points (a date ``at``) beside the intervals (closed, dates) that hold it: an equality join on buckets of days, then the exact test.

    An interval is put out once for each bucket it touches, so the width should be near a usual interval's length; no nested loop at any size.
    Null dates and intervals that end before they start match nothing.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    p = points.where(F.col(at).isNotNull()).withColumn("_b", F.floor(day(at) / width_days))
    sound = intervals.where(F.col(start) <= F.col(end))
    i = sound.withColumn("_b", F.explode(F.sequence(F.floor(day(start) / width_days), F.floor(day(end) / width_days))))
    return p.join(i, "_b").where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, row: str, width_days: int = 32) -> DataFrame:
    """left with ``as_of``: the row column of the latest right row of its keys at or before its time; ties in time go to the greater row. Both sides have the time under the name ``at``.

    One sort by keys and time inside spans of width_days, no inequality join; the latest right row before a span is carried in from the spans before it, of which there
    is one row each. So a key that holds a third of all rows is many tasks' work. Null keys and times find nothing.
    """
    span = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (width_days * 86_400_000_000)).alias("_span")
    seen = F.struct(F.col(at).alias("t"), F.col(row).alias("r"))
    none = F.lit(None).cast(f"struct<t:{dict(right.dtypes)[at]},r:{dict(right.dtypes)[row]}>")
    rest = [c for c in left.columns if c not in keys and c != at]
    inner = left.select(*keys, at, span, F.struct(*rest).alias("_l"), none.alias("_r"))
    mine = right.where(F.col(at).isNotNull()).select(*keys, at, span, F.lit(None).cast(inner.schema["_l"].dataType).alias("_l"), seen.alias("_r"))
    w = Window.partitionBy(*keys, "_span").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    placed = inner.unionByName(mine).withColumn("_in", F.max("_r").over(w)).where("_l is not null")
    ends = mine.groupBy(*keys, "_span").agg(F.max("_r").alias("_last"))
    spans = ends.unionByName(left.select(*keys, span).distinct().withColumn("_last", none)).groupBy(*keys, "_span").agg(F.max("_last").alias("_last"))
    before = spans.withColumn("_carry", F.max("_last").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    full = placed.join(before, [*keys, "_span"], "left")
    found = F.when(F.col(at).isNotNull() & (F.lit(True) if not keys else ~F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x)), F.coalesce(F.col("_in.r"), F.col("_carry.r")))
    return full.select(*keys, at, *[F.col("_l")[c].alias(c) for c in rest], found.alias("as_of")).select(*left.columns, "as_of")


def graph_health(tables: DataFrame, edges: DataFrame, weak: float = policy.APPROVED_CONFIDENCE) -> DataFrame:
    """n_tables, coverage (share with an edge), p50 and p95 of confidence, weak_ratio, orphan_ratio of a catalogue's join graph."""
    ends = edges.select(F.col("file_a").alias("t")).union(edges.select("file_b")).distinct()
    t = tables.select(F.col(tables.columns[0]).alias("t")).distinct().join(ends.withColumn("linked", F.lit(1)), "t", "left").agg(F.count(F.lit(1)).alias("n_tables"), F.coalesce(F.sum("linked"), F.lit(0)).alias("linked"))
    e = edges.agg(F.percentile("confidence", 0.5).alias("p50"), F.percentile("confidence", 0.95).alias("p95"), F.coalesce(F.avg(F.when(F.col("confidence") < weak, 1.0).otherwise(0.0)), F.lit(0.0)).alias("weak_ratio"))
    cover = F.try_divide("linked", "n_tables")
    return t.join(F.broadcast(e)).select("n_tables", cover.alias("coverage"), "p50", "p95", "weak_ratio", (1 - cover).alias("orphan_ratio"))  # one row each
