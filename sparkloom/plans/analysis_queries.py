"""Queries of join discovery, graphs, retrieval, documents and boards on the test tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkloom import policy
from sparkloom.functions import scalars
from sparkloom.operators import board, documents, drift, graph, hierarchy, knowledge, relate, search
from sparkloom.plans.registry import query, quoted
from sparkloom.plans.training_queries import _KEY
from sparkloom.session import durable, table

KEYS = [
    ("orders", "o_orderkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"),
    ("supplier", "s_suppkey"), ("supplier", "s_nationkey"), ("part", "p_partkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("region", "r_regionkey"), ("customer", "c_name"), ("part", "p_name"),
]


def _values(spark: SparkSession, d: str) -> DataFrame:
    return relate.hashed_values(relate.column_values({t: table(spark, d, t) for t in dict.fromkeys(t for t, _ in KEYS)}, KEYS))


_NORMAL = "CASE WHEN lower(trim({0})) NOT IN (" + quoted(policy.NULL_TOKENS) + ") AND trim({0}) <> '' THEN regexp_replace(regexp_replace(lower(trim({0})), '\\s+', ' ', 'g'), '^0+(\\d+)$', '\\1') END"
_FPS = "cells AS (" + " UNION ALL ".join(f"SELECT '{t}' AS file_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t}" for t, c in KEYS) + "), fps AS (SELECT file_name, column_name, substr(sha256(" + _NORMAL.format("value") + "), 1, 16) AS fp FROM cells)"
_REG = "reg AS (SELECT file_name, column_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT fp) AS BIGINT) AS cardinality, count(DISTINCT fp) / count(fp) AS unique_rate, (count(*) - count(fp)) / count(*) AS null_rate FROM fps GROUP BY 1, 2)"
_KIND = "CASE WHEN null_rate <= 0.01 AND unique_rate >= 0.98 THEN 'pk' WHEN null_rate <= 0.20 AND unique_rate BETWEEN 0.02 AND 0.80 THEN 'fk' END"
_OVERLAP = (
    "sizes AS (SELECT file_name, column_name, count(DISTINCT fp) AS n FROM fps WHERE fp IS NOT NULL GROUP BY 1, 2), d AS (SELECT DISTINCT * FROM fps WHERE fp IS NOT NULL), "
    "shared AS (SELECT a.file_name AS file_a, a.column_name AS column_a, b.file_name AS file_b, b.column_name AS column_b, count(*) AS n FROM d a JOIN d b ON a.fp = b.fp AND a.file_name <> b.file_name AND (a.file_name || chr(1) || a.column_name) < (b.file_name || chr(1) || b.column_name) GROUP BY 1, 2, 3, 4), "
    "overlap AS (SELECT s.file_a, s.column_a, s.file_b, s.column_b, CAST(s.n AS BIGINT) AS n_shared, s.n / least(x.n, y.n) AS overlap, CAST(x.n AS BIGINT) AS cardinality_a, CAST(y.n AS BIGINT) AS cardinality_b FROM shared s JOIN sizes x ON s.file_a = x.file_name AND s.column_a = x.column_name JOIN sizes y ON s.file_b = y.file_name AND s.column_b = y.column_name WHERE s.n >= 2 AND s.n / least(x.n, y.n) >= 0.01)"
)
_EDGES = (
    "edges AS (SELECT o.*, least(0.98, greatest(0.60, 0.75 * greatest(0, least(overlap, 1)) + 0.25 * least(1.0, log10(greatest(least(cardinality_a, cardinality_b), 1)) / 3))) AS confidence, "
    "CASE WHEN ra.k = 'pk' AND rb.k = 'pk' THEN 'one_to_one' WHEN ra.k = 'pk' THEN 'one_to_many' WHEN rb.k = 'pk' THEN 'many_to_one' ELSE 'many_to_many' END AS relationship_type FROM overlap o "
    "JOIN (SELECT *, " + _KIND + " AS k FROM reg) ra ON o.file_a = ra.file_name AND o.column_a = ra.column_name JOIN (SELECT *, " + _KIND + " AS k FROM reg) rb ON o.file_b = rb.file_name AND o.column_b = rb.column_name WHERE overlap >= 0.5 AND least(cardinality_a, cardinality_b) >= 8)"
)


@query("WITH " + _FPS + ", " + _REG + " SELECT file_name, column_name, n_rows, cardinality, round(unique_rate, 6) AS unique_rate, round(null_rate, 6) AS null_rate, " + _KIND + " AS key_kind FROM reg")
def key_registry(spark: SparkSession, d: str) -> DataFrame:
    return relate.key_registry(_values(spark, d)).withColumns({c: F.round(c, 6) for c in ("unique_rate", "null_rate")})


@query("WITH " + _FPS + ", " + _OVERLAP + " SELECT * REPLACE (round(overlap, 6) AS overlap) FROM overlap")
def fingerprint_overlap(spark: SparkSession, d: str) -> DataFrame:
    return relate.fingerprint_overlap(_values(spark, d)).withColumn("overlap", F.round("overlap", 6))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    v = durable(_values(spark, d))  # read, normalised and hashed once
    return relate.edges(relate.fingerprint_overlap(v), relate.key_registry(v))


@query("WITH " + _FPS + ", " + _REG + ", " + _OVERLAP + ", " + _EDGES + " SELECT file_a, column_a, file_b, column_b, round(overlap, 6) AS overlap, round(confidence, 6) AS confidence, 'INNER' AS join_type, relationship_type FROM edges")
def join_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("file_a", "column_a", "file_b", "column_b", F.round("overlap", 6).alias("overlap"), F.round("confidence", 6).alias("confidence"), "join_type", "relationship_type")


@query(
    "WITH " + _FPS + ", " + _REG + ", " + _OVERLAP + ", " + _EDGES + ", b AS (SELECT regexp_replace(column_name, '^[a-z]+_', '') AS k, count(DISTINCT file_name) / (SELECT count(DISTINCT file_name) FROM reg) AS wide FROM reg GROUP BY 1), s AS (SELECT edges.*, b.wide, regexp_replace(column_a, '^[a-z]+_', '') = regexp_replace(column_b, '^[a-z]+_', '') AS same FROM edges JOIN b ON b.k = regexp_replace(column_a, '^[a-z]+_', '')) SELECT file_a, column_a, file_b, column_b, "
    "CASE WHEN wide > 0.6 THEN 'candidate' WHEN same AND overlap >= 0.999 AND cardinality_a = cardinality_b THEN 'candidate' WHEN same THEN 'approved' WHEN relationship_type = 'many_to_many' THEN 'candidate' WHEN confidence >= 0.72 THEN 'approved' ELSE 'candidate' END AS status, "
    "CASE WHEN wide > 0.6 THEN 'ubiquitous/audit column, not a business key' WHEN same AND overlap >= 0.999 AND cardinality_a = cardinality_b THEN 'templated/copied column, not a referential key' WHEN same THEN NULL WHEN relationship_type = 'many_to_many' THEN 'many-to-many join can duplicate rows unless a grain rule approves it' WHEN confidence >= 0.72 THEN NULL ELSE 'needs stronger confidence or business approval' END AS reason FROM s"
)
def join_approval(spark: SparkSession, d: str) -> DataFrame:
    """Approval of the found edges by the ubiquity, overlap and confidence measured; the columns' prefixes are left out of the comparison of names."""
    v = durable(_values(spark, d))
    registry = durable(relate.key_registry(v))
    e = relate.edges(relate.fingerprint_overlap(v), registry)
    bare = lambda c: F.regexp_replace(c, "^[a-z]+_", "")
    wide = relate.ubiquity(registry.select(F.lit("star").alias("container_id"), F.col("file_name").alias("file_id"), bare("column_name").alias("column_name"))).select(F.col("column_name").alias("k"), "ubiquity")
    no = F.lit(False)
    said = relate.approval(bare("column_a") == bare("column_b"), F.col("ubiquity"), F.col("overlap"), F.col("cardinality_a"), F.col("cardinality_b"), F.col("confidence"), F.col("relationship_type"), no, no)
    return e.join(wide, bare("column_a") == F.col("k")).select("file_a", "column_a", "file_b", "column_b", said.alias("x")).select("file_a", "column_a", "file_b", "column_b", "x.status", "x.reason")


@query(
    "WITH f AS (SELECT id AS file_id, container_id, upper(regexp_extract(name, '^(.*)_(?:19|20)\\d{2}[_\\-]?\\d{2}(?:_[A-Za-z]+)?\\.\\w+$', 1)) AS t, regexp_extract(name, '((?:19|20)\\d{2})[_\\-]?(\\d{2})(?:_[A-Za-z]+)?\\.', 1) || '_' || regexp_extract(name, '((?:19|20)\\d{2})[_\\-]?(\\d{2})(?:_[A-Za-z]+)?\\.', 2) AS p FROM (SELECT DISTINCT id, container_id, name FROM files)), "
    "m AS (SELECT file_id, ingested_at, columns_info, CASE WHEN json_type(columns_info, '$[0]') = 'VARCHAR' THEN json_extract_string(columns_info, '$[*]') WHEN json_extract(columns_info, '$[0].name') IS NOT NULL THEN json_extract_string(columns_info, '$[*].name') ELSE json_extract_string(columns_info, '$[*].column') END AS n FROM file_metadata), "
    "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC, columns_info DESC) AS r FROM m WHERE len(n) > 0) WHERE r = 1), x AS (SELECT f.*, l.ingested_at, l.n, row_number() OVER (PARTITION BY container_id, t, p ORDER BY l.ingested_at DESC, f.file_id DESC) AS k FROM f JOIN l USING (file_id)), "
    "c AS (SELECT DISTINCT container_id, file_id, lower(trim(u)) AS column_name FROM (SELECT container_id, file_id, unnest(n) AS u FROM x WHERE k = 1) WHERE trim(u) <> ''), s AS (SELECT container_id, count(DISTINCT file_id) AS files FROM c GROUP BY 1) SELECT container_id, column_name, round(count(DISTINCT file_id) / files, 9) AS ubiquity FROM c JOIN s USING (container_id) GROUP BY container_id, column_name, files"
)
def column_ubiquity(spark: SparkSession, d: str) -> DataFrame:
    return relate.ubiquity(drift.monthly_columns(table(spark, d, "files"), table(spark, d, "file_metadata"))).withColumn("ubiquity", F.round("ubiquity", 9))


@query(
    "WITH m AS (SELECT container_id AS entity, file_id AS file_name, coalesce(ingestion_confidence_score, 0) AS u, CAST(row_count > 0 AS INT) AS k, row_number() OVER (PARTITION BY container_id, file_id ORDER BY ingested_at DESC, id DESC) AS rn FROM file_metadata), "
    "s AS (SELECT entity, file_name, 0.4 * u + 0.2 + 0.2 * k + 0.2 + 0 AS score FROM m WHERE rn = 1) SELECT entity, file_name, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, file_name DESC) AS r FROM s) WHERE r = 1"
)
def master_election(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("container_id", "file_id").orderBy(F.desc("ingested_at"), F.desc("id"))
    m = table(spark, d, "file_metadata").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    c = m.select(F.col("container_id").alias("entity"), F.col("file_id").alias("file_name"), F.coalesce("ingestion_confidence_score", F.lit(0.0)).alias("unique_rate"), F.lit(0.0).alias("null_rate"), (F.col("row_count") > 0).cast("int").alias("has_key"), F.lit(0.0).alias("measure_share"), F.lit(0).alias("inbound_edges"), F.lit(0.0).alias("ubiquity"))
    return relate.elect_masters(c).withColumn("score", F.round("score", 6))


@query(
    "WITH s AS (SELECT o_orderpriority AS subject, count(DISTINCT o_custkey) AS size FROM orders GROUP BY 1), h AS (SELECT o_orderpriority AS subject, count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT s.subject, 'customer' AS master, round(h.n / s.size, 6) AS share, CAST(h.n AS BIGINT) AS n, 'LINKED' AS outcome FROM s JOIN h ON s.subject = h.subject"
)
def value_reconcile(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "orders").select(F.col("o_orderpriority").alias("subject"), F.col("o_custkey").alias("value"))
    masters = table(spark, d, "customer").select(F.lit("customer").alias("master"), F.lit(0.9).alias("confidence"), F.col("c_custkey").alias("value")).unionByName(table(spark, d, "region").select(F.lit("region").alias("master"), F.lit(0.8).alias("confidence"), F.col("r_regionkey").alias("value")))
    return relate.reconcile_values(samples, masters).withColumn("share", F.round("share", 6))


@query(
    "WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS unit, avg(CAST(o_totalprice AS DOUBLE)) AS rate, count(*) AS volume, sum(CAST(o_totalprice AS DOUBLE)) AS total FROM orders GROUP BY 1, 2) SELECT period, lower(trim(unit)) AS unit, round(abs(rate * volume - total) / greatest(1.0, abs(total)), 6) AS gap, abs(rate * volume - total) / greatest(1.0, abs(total)) <= 0.05 AS ties FROM o"
)
def grain_reconcile(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderpriority").alias("unit")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("rate"), F.count(F.lit(1)).alias("volume"), F.sum(F.col("o_totalprice").cast("double")).alias("total"))
    return relate.reconcile_grain(o.select(F.upper("unit").alias("unit"), "period", "rate", "volume"), o.select("period", "unit", "total"))


# ---- graphs

_FOLDER_EDGES = "k AS (SELECT " + _KEY.format("id") + " AS a, " + _KEY.format("parent_id") + " AS b FROM folders), e AS (SELECT DISTINCT a, b FROM k WHERE a IS NOT NULL AND b IN (SELECT a FROM k))"


def _folder_edges(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "folders").select(hierarchy.canonical_id(F.col("id")).alias("a"), hierarchy.canonical_id(F.col("parent_id")).alias("b")).where("a is not null").distinct()
    return f.join(f.select(F.col("a").alias("b")).distinct(), "b", "left_semi")


@query("WITH RECURSIVE " + _FOLDER_EDGES + ", both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT r.node, x.b FROM reach r JOIN both_ x ON r.seen = x.a) SELECT node, min(seen) AS component FROM reach GROUP BY 1")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(_folder_edges(spark, d))


_TRADE = "t AS (SELECT cn.n_name AS a, sn.n_name AS b, CAST(count(*) AS DOUBLE) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE cn.n_name <> sn.n_name GROUP BY 1, 2), g AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(c) AS weight, sum(c) / (SELECT max(s) FROM (SELECT sum(c) AS s FROM t GROUP BY least(a, b), greatest(a, b))) AS confidence FROM t GROUP BY 1, 2)"


def _trade(spark: SparkSession, d: str) -> DataFrame:
    """Nations that trade with each other: a, b (a before b), weight (lines), confidence (share of the most)."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "s_nationkey").agg(F.count(F.lit(1)).alias("k"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    t = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.sum("k").cast("double").alias("k"))
    t = t.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("x")), "c_nationkey").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("y")), "s_nationkey")
    g = t.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("k").alias("weight"))
    return durable(g.join(F.broadcast(g.agg(F.max("weight").alias("most")))).select("a", "b", "weight", (F.col("weight") / F.col("most")).alias("confidence")))  # one row is broadcast


@query(
    "WITH RECURSIVE " + _TRADE + ", u AS (SELECT a AS src, b AS dst, confidence FROM g WHERE confidence >= 0.72 UNION ALL SELECT b, a, confidence FROM g WHERE confidence >= 0.72), w AS (SELECT 'NATION_6' AS start, 'NATION_6' AS fin, ['NATION_6'] AS path, 1e9 AS c UNION ALL SELECT w.start, u.dst, list_append(w.path, u.dst), least(w.c, u.confidence) FROM w JOIN u ON w.fin = u.src WHERE NOT list_contains(w.path, u.dst) AND len(w.path) <= 2), "
    "r AS (SELECT start, fin AS \"end\", CAST(len(path) - 1 AS BIGINT) AS hops, array_to_string(path, '>') AS path, round(c, 6) AS confidence, row_number() OVER (PARTITION BY fin ORDER BY len(path), c DESC, array_to_string(path, '>')) AS n FROM w WHERE len(path) > 1) SELECT start, \"end\", hops, path, confidence FROM r WHERE n <= 8"
)
def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    e = _trade(spark, d).where("confidence >= 0.72")
    return graph.bounded_paths(e, spark.createDataFrame([("NATION_6",)], "id string"), max_hops=2).withColumn("confidence", F.round("confidence", 6))


@query("WITH " + _TRADE + ", u AS (SELECT a AS src, b AS dst FROM g WHERE confidence >= 0.9 UNION SELECT b, a FROM g WHERE confidence >= 0.9), h AS (SELECT dst FROM u WHERE src IN ('NATION_6', 'NATION_7')) SELECT dst AS node FROM u WHERE src IN (SELECT dst FROM h) AND dst NOT IN ('NATION_6', 'NATION_7') UNION SELECT dst FROM h WHERE dst NOT IN ('NATION_6', 'NATION_7')")
def graph_two_hop(spark: SparkSession, d: str) -> DataFrame:
    e = _trade(spark, d).where("confidence >= 0.9")
    seeds = spark.createDataFrame([("NATION_6",), ("NATION_7",)], "node string")
    one = graph.neighbours(e, seeds)
    two = graph.neighbours(e, one.union(seeds))
    return one.union(two).distinct()


@query("WITH " + _TRADE + ", u AS (SELECT a AS src, b AS dst, confidence FROM g UNION ALL SELECT b, a, confidence FROM g) SELECT dst AS node, CAST(count(DISTINCT src) AS BIGINT) AS n_linked, round(min(confidence), 6) AS min_confidence FROM u WHERE src IN ('NATION_6', 'NATION_7', 'NATION_18') AND dst NOT IN ('NATION_6', 'NATION_7', 'NATION_18') GROUP BY 1 HAVING count(DISTINCT src) >= 2")
def graph_bridges(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([("NATION_6",), ("NATION_7",), ("NATION_18",)], "node string")
    return graph.bridges(_trade(spark, d), s).withColumn("min_confidence", F.round("min_confidence", 6))


@query(
    "WITH " + _TRADE + ", u AS (SELECT a AS src, b AS dst, confidence FROM g WHERE confidence >= 0.72 UNION ALL SELECT b, a, confidence FROM g WHERE confidence >= 0.72), deg AS (SELECT src AS dst, count(DISTINCT dst) AS degree FROM u GROUP BY 1), "
    "s AS (SELECT u.src, u.dst, confidence * CASE WHEN degree > 15 THEN 0.8 ELSE 1.0 END AS score FROM u JOIN deg ON u.dst = deg.dst WHERE u.src IN ('NATION_6', 'NATION_7') AND u.dst NOT IN ('NATION_6', 'NATION_7')) SELECT dst AS node, round(max(score), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM s) WHERE r <= 10 GROUP BY 1"
)
def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand_one_hop(_trade(spark, d), spark.createDataFrame([("NATION_6",), ("NATION_7",)], "node string")).withColumn("score", F.round("score", 6))


def _unrolled(rounds: int) -> str:
    q = "WITH " + _TRADE + ", u AS (SELECT a AS src, b AS dst, weight AS w FROM g UNION ALL SELECT b, a, weight FROM g), o AS (SELECT src, sum(w) AS total FROM u GROUP BY 1), p AS (SELECT u.src, u.dst, w / total AS p FROM u JOIN o ON u.src = o.src), n AS (SELECT count(*) AS n FROM o), r0 AS (SELECT src AS node, 1.0 / (SELECT n FROM n) AS rank FROM o)"
    for i in range(rounds):
        q += f", r{i + 1} AS (SELECT o.src AS node, 0.15 / (SELECT n FROM n) + 0.85 * coalesce((SELECT sum(p.p * r.rank) FROM p JOIN r{i} r ON p.src = r.node WHERE p.dst = o.src), 0) AS rank FROM o)"
    return q + f" SELECT node, round(rank, 8) AS rank FROM r{rounds}"


@query(_unrolled(5))
def pagerank_trade(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_trade(spark, d), rounds=5).withColumn("rank", F.round("rank", 8))


@query()
def communities_of_entities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of names and the chunks they stand in. Each name is linked to its chunks, so all names of a chunk are joined without a row for each pair of them."""
    e = table(spark, d, "entities").where("name is not null and src_chunk_id is not null")
    return documents.communities(e.groupBy(F.concat_ws(":", F.lit("n"), "tenant_id", F.lower("name")).alias("a"), F.concat_ws(":", F.lit("c"), "src_chunk_id").alias("b")).agg(F.max(F.coalesce("confidence", F.lit(0.5))).alias("weight")))


# ---- retrieval

_TERMS = {"q1": ["inventory", "agreement", "rejected"], "q2": ["lieferant", "rechnung"], "q3": ["shipment", "warehouse", "tariff", "deposit"]}


def _bm25_sql(terms: list[str], top: int = 20) -> str:
    t = ", ".join(f"len(list_filter(w, lambda x: x = '{x}')) AS t{i}" for i, x in enumerate(terms))
    idf = ", ".join(f"ln(1 + (count(*) - count(*) FILTER (t{i} > 0) + 0.5) / (count(*) FILTER (t{i} > 0) + 0.5)) AS i{i}" for i in range(len(terms)))
    score = " + ".join(f"i{i} * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    return f"SELECT doc_id, round({score}, 6) AS score FROM (SELECT doc_id, len(w) AS n, {t} FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents)) d, (SELECT avg(n) AS mean, {idf} FROM (SELECT len(w) AS n, {t} FROM (SELECT list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents))) s WHERE {score} > 0 ORDER BY round({score}, 6) DESC, doc_id LIMIT {top}"


@query(" UNION ALL ".join(f"SELECT '{q}' AS q, * FROM ({_bm25_sql(t)})" for q, t in _TERMS.items()))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_many(table(spark, d, "documents"), _TERMS, "doc_id", "text")


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: list_transform(range(1, CAST(len(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS BIGINT), 3)))))"


@query("SELECT DISTINCT entity_id, score FROM (SELECT entity_id, round(len(list_intersect(" + _GRAMS.format("'trading company'") + ", " + _GRAMS.format("name") + ")) / len(" + _GRAMS.format("'trading company'") + "), 6) AS score FROM entities WHERE name IS NOT NULL) WHERE score >= 0.2 ORDER BY score DESC, entity_id LIMIT 20")
def trigram_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return search.trigram_search(table(spark, d, "entities"), "trading company", "entity_id", "name")


@query("SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, r.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 5) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors of every vector whose id is divisible by 50, out of all."""
    rows = table(spark, d, "embeddings")
    return search.exact_topk(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).withColumn("score", F.round("score", 5))


@query("WITH a AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 0 AS l FROM (" + _bm25_sql(_TERMS["q1"]) + ")), b AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 1 AS l FROM (" + _bm25_sql(_TERMS["q3"]) + ")), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT doc_id, round(sum(1.0 / (60 + rank)), 10) AS score FROM u GROUP BY 1 ORDER BY score DESC, min((l, rank)), doc_id LIMIT 20")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    hits = durable(search.bm25_many(table(spark, d, "documents"), {q: _TERMS[q] for q in ("q1", "q3")}, "doc_id", "text"))  # two top-k lists
    return search.rrf([hits.where(F.col("q") == q).drop("q") for q in ("q1", "q3")], "doc_id")


@query("SELECT file_id, round(max(s), 9) AS score FROM (SELECT file_id, coalesce(ingestion_confidence_score, 0) * greatest(0.6, 1 - 0.5 * (1 - coalesce(ingestion_confidence_score, 1.0))) AS s FROM file_metadata) WHERE s >= 0.05 GROUP BY 1")
def trust_attenuate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("ingestion_confidence_score")
    hits = table(spark, d, "file_metadata").select("file_id", search.attenuate(F.coalesce(c, F.lit(0.0)), c).alias("score"))
    return search.prune(hits, "file_id").withColumn("score", F.round("score", 9))


@query("SELECT f.id FROM files f LEFT JOIN (SELECT DISTINCT id FROM folders WHERE owner_id < '8') o ON f.folder_id = o.id WHERE f.owner_id < '2' OR o.id IS NOT NULL")
def permission_filter(spark: SparkSession, d: str) -> DataFrame:
    """Files a group of users owns, or in folders another group owns."""
    f = table(spark, d, "files")
    own = table(spark, d, "folders").where("owner_id < '8'").select(F.col("id").alias("folder_id"), F.lit(True).alias("ok")).distinct()
    return f.join(own, "folder_id", "left").where((F.col("owner_id") < "2") | F.col("ok")).select("id")


@query("SELECT id FROM file_metadata WHERE (date_range_end IS NULL OR date_range_end >= DATE '2023-03-01') AND (date_range_start IS NULL OR date_range_start <= DATE '2023-06-30')")
def date_overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = F.lit("2023-03-01").cast("date"), F.lit("2023-06-30").cast("date")
    return table(spark, d, "file_metadata").where(scalars.windows_overlap(F.col("date_range_start"), F.col("date_range_end"), lo, hi)).select("id")


@query("SELECT count(*) FILTER (file_id IS NULL) AS no_row, CAST(count(*) AS BIGINT) AS n, CAST(count(ingestion_confidence_score) AS BIGINT) AS scored, round(avg(CASE WHEN coalesce(ingestion_confidence_score, 0) = 0 THEN 0.7 ELSE ingestion_confidence_score END), 6) AS avg_confidence, round(quantile_cont(ingestion_confidence_score, 0.5), 6) AS p50, round(quantile_cont(ingestion_confidence_score, 0.95), 6) AS p95 FROM file_metadata")
def ingestion_health(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all files; a missing or zero score counts as the neutral 0.7 in the mean."""
    c = F.col("ingestion_confidence_score")
    return table(spark, d, "file_metadata").agg(F.sum(F.when(F.col("file_id").isNull(), 1).otherwise(0)).alias("no_row"), F.count(F.lit(1)).alias("n"), F.count(c).alias("scored"), F.round(F.avg(F.when(F.coalesce(c, F.lit(0.0)) == 0, 0.7).otherwise(c)), 6).alias("avg_confidence"), F.round(F.percentile(c, 0.5), 6).alias("p50"), F.round(F.percentile(c, 0.95), 6).alias("p95"))


# ---- documents

_TEXT = "coalesce(text, '')"


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(trim(" + _TEXT + "), '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda x: x <> '')) AS BIGINT) AS n_sentences, CAST(len(list_filter(regexp_split_to_array(" + _TEXT + ", '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents")
def sentence_token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.size(scalars.sentences(t)).cast("long").alias("n_sentences"), scalars.token_count(t).alias("n_tokens"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")


@query(
    "WITH l AS (SELECT doc_id, line_no - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL) WHERE trim(line) <> ''), "
    "h AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS body FROM l), g AS (SELECT *, CAST(len(string_split(body, ' ')) <= 8 AND length(body) <= 80 AS INT) AS head FROM h), "
    "o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1 THEN 1 WHEN max(head) OVER (PARTITION BY doc_id) > 0 THEN head ELSE 0 END AS opens FROM g), "
    "s AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS section_no FROM o) SELECT doc_id, section_no, CAST(count(*) AS BIGINT) AS n_chunks, CAST(min(line_no) AS BIGINT) AS first, CAST(max(line_no) AS BIGINT) AS last, substr(sha256(string_agg(body, chr(10) ORDER BY line_no)), 1, 16) AS fingerprint FROM s GROUP BY 1, 2"
)
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return documents.sectionize(_lines(spark, d), "doc_id", "line_no", "line").withColumns({c: F.col(c).cast("long") for c in ("first", "last")})


@query("WITH h AS (SELECT doc_id, tenant_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents WHERE text IS NOT NULL) SELECT DISTINCT doc_id, min(doc_id) OVER w AS keep_key, CAST(count(*) OVER w AS BIGINT) AS n_copies FROM h WINDOW w AS (PARTITION BY tenant_id, h)")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return documents.content_dedup(table(spark, d, "documents"), "doc_id", "text", "tenant_id")


@query("WITH c AS (SELECT DISTINCT section_id AS k, unnest(regexp_extract_all(text, '\\b[A-Z]{2,}-\\d+\\b')) AS code FROM sections), f AS (SELECT * FROM c WHERE code IN (SELECT code FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8)) SELECT a.k AS key_a, b.k AS key_b, CAST(count(*) AS BIGINT) AS n_shared FROM f a JOIN f b ON a.code = b.code AND a.k < b.k GROUP BY 1, 2")
def section_value_links(spark: SparkSession, d: str) -> DataFrame:
    return documents.value_links(table(spark, d, "sections"), "section_id", "text")


_WORDS = "SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: length(x) >= 3)) AS term FROM documents"


@query("WITH b AS (SELECT term, log10(count(*)) - log10((SELECT count(*) FROM (" + _WORDS + " WHERE source = 'report'))) AS log_rate FROM (" + _WORDS + " WHERE source = 'report') GROUP BY 1), f AS (SELECT term, count(*) AS n FROM (" + _WORDS + " WHERE source = 'contract') GROUP BY 1) SELECT f.term, CAST(f.n AS BIGINT) AS n, round(log10(f.n) - log10((SELECT sum(n) FROM f)) - coalesce(log_rate, -6.0), 4) AS lift FROM f LEFT JOIN b ON f.term = b.term WHERE log10(f.n) - log10((SELECT sum(n) FROM f)) - coalesce(log_rate, -6.0) >= 1.5")
def glossary_lift(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    words = docs.where("source = 'report'").select(F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) >= 3)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    background = words.join(F.broadcast(words.agg(F.sum("n").alias("t")))).select("term", (F.log10("n") - F.log10("t")).alias("log_rate"))  # one row is broadcast
    return documents.glossary_lift(docs.where("source = 'contract'"), "text", background)


@query("SELECT tenant_id, min(doc_date) AS first_date, max(doc_date) AS last_date, CAST(count(*) AS BIGINT) AS n_mentions, round(count(*) / (date_diff('day', min(doc_date), max(doc_date)) + 1), 6) AS per_day FROM documents WHERE doc_date IS NOT NULL AND tenant_id IS NOT NULL GROUP BY 1")
def temporal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return documents.coverage(table(spark, d, "documents"), "tenant_id", "doc_date")


@query("SELECT entity_id, e.name FROM (SELECT DISTINCT entity_id, name, span FROM entities) e WHERE CASE WHEN length(name) <= 3 THEN contains(' ' || regexp_replace(lower(span), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', ' ' || lower(name) || ' ') ELSE contains(lower(span), lower(name)) END")
def grounded_span(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("entity_id", "name", "span").distinct().where(documents.grounded(F.col("name"), F.col("span"))).select("entity_id", "name")


@query()
def chunk_text_greedy(spark: SparkSession, d: str) -> DataFrame:
    return documents.chunk_text(table(spark, d, "documents"), "doc_id", "text", 120, 20)


@query("WITH p AS (SELECT string_split(p_name, ' ') AS w FROM part), l AS (SELECT array_to_string(list_transform(w, lambda x: upper(x[1]) || substr(x, 2)), ' ') AS long_form, upper(array_to_string(list_transform(w, lambda x: x[1]), '')) AS short FROM p WHERE len(w) >= 2) SELECT short, CASE WHEN count(DISTINCT lower(long_form)) > 1 THEN 'CONFLICTING' ELSE 'STATED' END AS status, min(long_form) AS long_form FROM l GROUP BY 1")
def acronym_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Short forms of parts, read from sentences that define them in three ways; one of several expansions is conflicting."""
    w = F.transform(F.split("p_name", " "), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000)))
    long, short = F.array_join(w, " "), F.upper(F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), ""))
    way = F.pmod("p_partkey", F.lit(3))
    text = F.when(way == 0, F.concat(F.lit("we stock the "), long, F.lit(" ("), short, F.lit(") here."))).when(way == 1, F.concat(F.lit("of these "), short, F.lit(" ("), long, F.lit(") is one."))).otherwise(F.concat(F.lit("in short "), short, F.lit(" stands for "), long, F.lit(".")))
    return documents.reconcile_terms(documents.definitions(table(spark, d, "part").where("p_name like '% %'").select("p_partkey", text.alias("text")), "p_partkey", "text"))


_CONFLICT_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN (" + quoted(policy.CONFLICT_STOP) + ")))"


@query("WITH c AS (SELECT DISTINCT doc_id AS k, tenant_id, regexp_matches(lower(text), '\\b(?:not|no|never|none|without|cannot|neither|nor)\\b') AS neg, " + _CONFLICT_WORDS + " AS w FROM documents WHERE text IS NOT NULL AND tenant_id IS NOT NULL), u AS (SELECT k, tenant_id, neg, unnest(w) AS w FROM c) SELECT least(a.k, b.k) AS key_a, greatest(a.k, b.k) AS key_b, CAST(count(*) AS BIGINT) AS n_shared FROM u a JOIN u b ON a.tenant_id = b.tenant_id AND a.w = b.w AND NOT a.neg AND b.neg GROUP BY a.k, b.k HAVING count(*) >= 2")
def negation_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return documents.conflicts(table(spark, d, "documents").where("text is not null"), "doc_id", "text", "tenant_id")


@query("SELECT section_id, substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 480) || ' | ' || array_to_string(list_slice(chunk_ids, 1, 5), ', ') AS card FROM (SELECT DISTINCT section_id, text, chunk_ids FROM sections)")
def section_cards(spark: SparkSession, d: str) -> DataFrame:
    return documents.cards(table(spark, d, "sections").select("section_id", "text", "chunk_ids").distinct(), "section_id", "text", "chunk_ids")


@query("SELECT id, regexp_replace(trim(upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '(?:[_\\- ](?:tab|pipe|csv|xlsx|xls|txt|tsv|parquet))+$', '', 'i'), '[_\\- ](?:19|20)\\d{2}(?:[_\\-]?\\d{2}){0,2}$', ''), '[^A-Za-z0-9_]', '_', 'g')), '_'), '_+', '_', 'g') AS table_name, regexp_extract(name, '((?:19|20)\\d{2})[_\\-]?(\\d{2})(?:_[A-Za-z]+)?\\.', 1) || '_' || regexp_extract(name, '((?:19|20)\\d{2})[_\\-]?(\\d{2})(?:_[A-Za-z]+)?\\.', 2) AS period FROM files")
def logical_tables(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", scalars.logical_table(F.col("name")).alias("table_name"), scalars.file_period(F.col("name")).alias("period"))


@query("SELECT container_id, table_name, CAST(count(DISTINCT period) AS BIGINT) AS n_periods, min(period) AS first_period, max(period) AS last_period FROM (SELECT container_id, upper(regexp_extract(name, '^(.*)_(?:19|20)\\d{2}[_\\-]?\\d{2}(?:_[A-Za-z]+)?\\.\\w+$', 1)) AS table_name, regexp_extract(name, '((?:19|20)\\d{2})[_\\-]?(\\d{2})(?:_[A-Za-z]+)?\\.', 1) || '_' || regexp_extract(name, '((?:19|20)\\d{2})[_\\-]?(\\d{2})(?:_[A-Za-z]+)?\\.', 2) AS period FROM files) GROUP BY 1, 2")
def logical_table_coverage(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("container_id", scalars.logical_table(F.col("name")).alias("table_name"), scalars.file_period(F.col("name")).alias("period"))
    return f.groupBy("container_id", "table_name").agg(F.count_distinct("period").alias("n_periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


# ---- boards


@query("WITH p AS (SELECT 'price' AS measure, o_orderpriority AS table_name, sum(CAST(o_totalprice AS DOUBLE)) * 1.02 AS parts, sum(CAST(o_totalprice AS DOUBLE)) AS whole FROM orders GROUP BY 2) SELECT measure, table_name, round(parts, 2) AS parts, round(whole, 2) AS whole, parts > whole * 1.01 AS double_counted FROM p")
def tieout_check(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.lit("price").alias("measure"), F.col("o_orderpriority").alias("table_name")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("value"))
    return board.tie_out(o.withColumn("value", F.col("value") * 1.02), o).withColumns({c: F.round(c, 2) for c in ("parts", "whole")})


@query("WITH m AS (SELECT DISTINCT 'kind' AS role, container_id AS t, lower(trim(folder_kind)) AS m FROM folders WHERE trim(folder_kind) <> '' AND container_id IS NOT NULL), s AS (SELECT t, list(m) AS s FROM m GROUP BY 1 HAVING count(*) <= 50), p AS (SELECT a.t AS ta, b.t AS tb, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM s a JOIN s b ON a.t < b.t) SELECT 'kind' AS role, round(min(j), 6) AS min_jaccard, (SELECT CAST(count(*) AS BIGINT) FROM s) AS n_tables FROM p HAVING min(j) >= 0.5")
def conformed_jaccard(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "folders").where("container_id is not null").select(F.lit("kind").alias("role"), F.col("container_id").alias("table_name"), F.col("folder_kind").alias("member"))
    return board.conformed_dimensions(m)


@query("WITH t AS (SELECT l_returnflag AS label, sum(CAST(l_extendedprice AS DOUBLE)) AS v FROM lineitem GROUP BY 1) SELECT label, round(v, 2) AS value, round(v / (SELECT sum(v) FROM t), 6) AS share FROM t ORDER BY value DESC, label LIMIT 10")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return board.share_of_total(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query("SELECT least(max(e), DATE '2025-01-15') AS as_of FROM (SELECT date_range_end AS e FROM file_metadata WHERE date_range_end < DATE '2400-01-01')")
def as_of_date(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("date_range_end")
    return table(spark, d, "file_metadata").agg(F.least(F.max(F.when(F.year(e) < 2400, e)), F.lit("2025-01-15").cast("date")).alias("as_of"))


@query("WITH " + _FPS + ", " + _REG + ", " + _OVERLAP + ", " + _EDGES + ", t AS (SELECT DISTINCT file_name AS t FROM cells), l AS (SELECT file_a AS t FROM edges UNION SELECT file_b FROM edges) SELECT (SELECT count(*) FROM t) AS n_tables, round((SELECT count(*) FROM l) / (SELECT count(*) FROM t), 6) AS coverage, round(quantile_cont(confidence, 0.5), 6) AS p50, round(quantile_cont(confidence, 0.95), 6) AS p95, round(avg(CASE WHEN confidence < 0.72 THEN 1.0 ELSE 0.0 END), 6) AS weak_ratio, round(1 - (SELECT count(*) FROM l) / (SELECT count(*) FROM t), 6) AS orphan_ratio FROM edges")
def graph_health(spark: SparkSession, d: str) -> DataFrame:
    tables = spark.createDataFrame([(t,) for t in dict.fromkeys(t for t, _ in KEYS)], "t string")
    h = relate.graph_health(tables, durable(_edges(spark, d)))
    return h.withColumns({c: F.round(c, 6) for c in ("coverage", "p50", "p95", "weak_ratio", "orphan_ratio")})


_MENTIONS = "m AS (SELECT DISTINCT tenant_id || ':' || lower(name) AS entity, src_chunk_id AS chunk FROM entities WHERE src_chunk_id IS NOT NULL AND name IS NOT NULL AND tenant_id IS NOT NULL)"


@query("WITH " + _MENTIONS + ", s AS (SELECT DISTINCT tenant_id || ':' || lower(name) AS seed FROM entities WHERE entity_id % 50 = 0 AND src_chunk_id IS NOT NULL AND name IS NOT NULL AND tenant_id IS NOT NULL), c0 AS (SELECT DISTINCT seed, chunk FROM s JOIN m ON seed = entity), e1 AS (SELECT DISTINCT seed, entity FROM c0 JOIN m USING (chunk)), c1 AS (SELECT DISTINCT seed, chunk FROM e1 JOIN m USING (entity)), e2 AS (SELECT DISTINCT seed, entity FROM c1 JOIN m USING (chunk)), c2 AS (SELECT DISTINCT seed, chunk FROM e2 JOIN m USING (entity)) SELECT seed, chunk, CAST(min(h) AS BIGINT) AS hops FROM (SELECT *, 0 AS h FROM c0 UNION ALL SELECT *, 1 FROM c1 UNION ALL SELECT *, 2 FROM c2) GROUP BY 1, 2")
def graph_walk_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks within two steps of the name of every mention whose id is divisible by 50; a step leads to all names of a chunk."""
    e = table(spark, d, "entities").where("src_chunk_id is not null and name is not null and tenant_id is not null").select("entity_id", F.concat_ws(":", "tenant_id", F.lower("name")).alias("entity"), F.col("src_chunk_id").alias("chunk"))
    return knowledge.walk_co_mentions(e.select("entity", "chunk").distinct(), e.where("entity_id % 50 = 0").select("entity").distinct())


_CARDS = "c AS (SELECT doc_id AS unit, card_id AS k, min(embedding) AS e FROM doc_cards WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 GROUP BY 1, 2)"


@query(
    "WITH RECURSIVE " + _CARDS + ", p AS (SELECT a.unit, a.k AS x, b.k AS y, greatest(0, least(1, list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])))) AS s FROM c a JOIN c b ON a.unit = b.unit AND a.k < b.k), q AS (SELECT unit, greatest(quantile_cont(s, 0.85), 0.6) AS band FROM p GROUP BY 1), "
    "l AS (SELECT x, y FROM p JOIN q USING (unit) WHERE s >= band), u AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l), r AS (SELECT k AS node, k AS seen FROM c UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT node AS card_id, min(seen) AS cluster FROM r GROUP BY 1"
)
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    """Cards of one document merged by their vectors."""
    e = F.col("embedding")
    sound = table(spark, d, "doc_cards").where((F.size(e) == 64) & ~F.exists(e, lambda x: F.isnan(x)) & F.exists(e, lambda x: x != 0))
    cards = sound.groupBy("doc_id", "card_id").agg(F.min("embedding").alias("embedding")).select("doc_id", "card_id", F.lit("card").alias("kind"), F.lit(None).cast("string").alias("chunk"), "embedding")
    return knowledge.merge_mentions(cards, "doc_id", "card_id", "kind", "chunk", "embedding")
