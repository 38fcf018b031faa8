"""Queries of trust, access, roles, pins, answers and documents on the test tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkloom import policy
from sparkloom.operators import catalog, drift, governance as g, search
from sparkloom.plans.registry import query, quoted
from sparkloom.session import table

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC NULLS LAST, id DESC) AS rn FROM file_metadata WHERE file_id IS NOT NULL) WHERE rn = 1)"


def _latest(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return catalog.newest(table(spark, d, "file_metadata").where("file_id is not null").select("file_id", "ingested_at", "id", *columns), ["file_id"], ["ingested_at", "id"])


# ---- trust and access


@query(
    "WITH m AS " + _LATEST + ", f AS (SELECT file_id, 'error' AS severity FROM file_metadata WHERE ingest_error IS NOT NULL), e AS (SELECT DISTINCT file_id FROM f) "
    "SELECT m.file_id, CASE WHEN e.file_id IS NOT NULL OR m.ingestion_confidence_score < 0.6 THEN 'QUARANTINED' WHEN m.ingestion_confidence_score < 0.8 THEN 'SHADOW' ELSE 'TRUSTED' END AS state FROM m LEFT JOIN e ON m.file_id = e.file_id"
)
def trust_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Each file's trust state from its confidence and its own findings."""
    findings = table(spark, d, "file_metadata").where("ingest_error is not null").select("file_id", F.lit("Error ").alias("severity"))
    return g.sweep_trust(_latest(spark, d, "ingestion_confidence_score").select("file_id", F.col("ingestion_confidence_score").alias("score")), findings)


@query("WITH h AS (SELECT id, container_id, coalesce(upper(trust_state), '') <> 'QUARANTINED' AS ok FROM file_metadata) SELECT id FROM (SELECT *, bool_or(ok) OVER (PARTITION BY container_id) AS any_ok FROM h) WHERE ok OR NOT any_ok")
def quarantine_filter(spark: SparkSession, d: str) -> DataFrame:
    """Hits without the quarantined ones, container by container; one that has nothing else keeps them."""
    return g.drop_quarantined(table(spark, d, "file_metadata").select("id", "container_id", "trust_state"), "container_id", "trust_state").select("id")


@query("SELECT m.id FROM file_metadata m WHERE container_id IN (SELECT container_id FROM folders WHERE organization_id = 'org-0003')")
def org_filter(spark: SparkSession, d: str) -> DataFrame:
    return g.of_organisation(table(spark, d, "file_metadata"), table(spark, d, "folders"), "org-0003").select("id")


@query("WITH f AS (SELECT DISTINCT id, owner_id, uploaded_by_id FROM files) SELECT m.id FROM file_metadata m JOIN f ON f.id = m.file_id WHERE (f.owner_id = (SELECT max(owner_id) FROM files) OR f.uploaded_by_id = (SELECT max(owner_id) FROM files)) AND (date_range_end IS NULL OR date_range_end >= DATE '2022-01-01') AND (date_range_start IS NULL OR date_range_start <= DATE '2024-12-31')")
def base_select(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    user = files.agg(F.max("owner_id")).first()[0]
    return g.base_select(table(spark, d, "file_metadata"), files, user, date_from="2022-01-01", date_to="2024-12-31").select("id")


@query("WITH s AS (SELECT file_id FROM " + _LATEST + " WHERE file_id IS NOT NULL ORDER BY ingestion_confidence_score DESC NULLS LAST, file_id LIMIT 25) SELECT id, columns_info FROM file_metadata WHERE file_id IN (SELECT file_id FROM s)")
def hydrated_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """A shortlist ranked on narrow columns, then its heavy ones."""
    lean = _latest(spark, d, "ingestion_confidence_score").orderBy(F.desc_nulls_last("ingestion_confidence_score"), "file_id").limit(25)
    return g.hydrate(lean, table(spark, d, "file_metadata").select("file_id", "id", "columns_info"), "file_id").select("id", "columns_info")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def row_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty rows."""
    return table(spark, d, "orders").orderBy("o_orderkey").limit(20)


@query("SELECT DISTINCT lower(trim(domain_tag)) AS domain FROM folders WHERE trim(domain_tag) <> ''")
def domain_inventory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "folders").where("trim(domain_tag) <> ''").select(F.lower(F.trim("domain_tag")).alias("domain")).distinct()


# ---- roles: each column of a month's file has the role of its name, its kind by the name's last part

_ROLE = "'custom:' || CASE WHEN column_name LIKE '%\\_id' ESCAPE '\\' OR column_name LIKE '%\\_no' ESCAPE '\\' THEN 'entity_key' WHEN column_name LIKE '%date%' THEN 'date' WHEN column_name LIKE '%amount%' OR column_name LIKE '%price%' THEN 'additive_measure' ELSE 'attribute' END || ':' || replace(column_name, '_', ' ')"
_NAMES = (
    "n AS (SELECT file_id, unnest(CASE WHEN json_type(columns_info, '$[0]') = 'VARCHAR' THEN json_extract_string(columns_info, '$[*]') WHEN json_extract(columns_info, '$[0].name') IS NOT NULL THEN json_extract_string(columns_info, '$[*].name') ELSE json_extract_string(columns_info, '$[*].column') END) AS c FROM file_metadata WHERE file_id IS NOT NULL), "
    "c AS (SELECT DISTINCT file_id, lower(trim(c)) AS column_name FROM n WHERE trim(c) <> ''), r AS (SELECT file_id, column_name, " + _ROLE + " AS role, regexp_extract(" + _ROLE + ", '^custom:([a-z_]+):', 1) AS kind, replace(column_name, '_', ' ') AS label FROM c)"
)


def _roles(spark: SparkSession, d: str) -> DataFrame:
    cols = drift.declared_columns(F.col("columns_info"))
    name = F.lower(F.trim("x.name"))
    c = table(spark, d, "file_metadata").where("file_id is not null").select("file_id", F.explode(cols).alias("x")).select("file_id", name.alias("column_name")).where("column_name <> ''").distinct()
    n = F.col("column_name")
    kind = F.when(n.endswith("_id") | n.endswith("_no"), "entity_key").when(n.contains("date"), "date").when(n.contains("amount") | n.contains("price"), "additive_measure").otherwise("attribute")
    return c.withColumn("role", F.concat(F.lit("custom:"), kind, F.lit(":"), F.replace(n, F.lit("_"), F.lit(" "))))


@query("WITH " + _NAMES + " SELECT DISTINCT file_id FROM r WHERE list_has_any(regexp_split_to_array(label, '[^a-z0-9]+'), ['net', 'amount', 'plant'])")
def role_cluster_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose roles share a word with entities that are sure enough."""
    e = spark.createDataFrame([("Net Amount", 0.9), ("plant", 0.8), ("vendor", 0.2)], "name string, confidence double")
    return g.files_by_role(_roles(spark, d), e, floor=0.7)


@query("WITH " + _NAMES + " SELECT DISTINCT file_id FROM r WHERE list_has_any(regexp_split_to_array(label, '[^a-z0-9]+'), ['tax', 'due'])")
def shared_role_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Files whose roles share a word of three letters with any entity."""
    return g.files_by_role(_roles(spark, d), spark.createDataFrame([("tax of it",), ("is due",)], "name string"), least=3)


@query("WITH " + _NAMES + ", k AS (SELECT file_id, kind, kind AS label, count(*) AS n, list_sort(list(column_name)) AS cols FROM r GROUP BY 1, 2, 3) SELECT file_id, kind, label, CAST(n AS BIGINT) AS n, array_to_string(cols[1:20], ',') AS columns FROM k WHERE n >= 2")
def same_role_groups(spark: SparkSession, d: str) -> DataFrame:
    """Columns of one file that share a role; the roles are cut to their kinds here."""
    r = _roles(spark, d).withColumn("role", F.regexp_replace("role", "^custom:([a-z_]+):.*$", "custom:$1:$1"))
    return g.role_groups(r).withColumn("columns", F.array_join("columns", ","))


@query("WITH " + _NAMES + ", h AS (SELECT file_id, bool_or(" + " OR ".join(f"contains(role, '{w}')" for w in policy.CUSTOMER_WORDS) + ") AS c, bool_or(" + " OR ".join(f"contains(role, '{w}')" for w in policy.VENDOR_WORDS) + ") AS v FROM r GROUP BY 1) SELECT file_id, CASE WHEN c AND NOT v THEN 'customer' WHEN v AND NOT c THEN 'vendor' ELSE 'neutral' END AS polarity FROM h")
def role_polarity(spark: SparkSession, d: str) -> DataFrame:
    return g.polarity(_roles(spark, d))


@query("WITH " + _NAMES + ", k AS (SELECT file_id, min(column_name) FILTER (kind = 'entity_key') AS primary_key, array_to_string(list_sort(list(column_name) FILTER (kind = 'additive_measure')), ',') AS metrics, array_to_string(list_sort(list(column_name) FILTER (kind <> 'additive_measure')), ',') AS dimensions FROM r GROUP BY 1) SELECT file_id, replace(primary_key, '_', ' ') AS entity_name, primary_key, coalesce(metrics, '') AS metrics, coalesce(dimensions, '') AS dimensions, CASE WHEN primary_key IS NOT NULL THEN 0.9 ELSE 0.6 END AS confidence FROM k")
def entity_specs(spark: SparkSession, d: str) -> DataFrame:
    """What one row of each file is; columns in the order of their names here."""
    r = _roles(spark, d).withColumn("position", F.lit(0))
    return g.entity_specs(r).drop("attributes").withColumns({c: F.array_join(c, ",") for c in ("metrics", "dimensions")})


_JOINS = "w AS (SELECT min(file_id) AS f, column_name FROM c GROUP BY 2), j AS (SELECT a.f AS file_a, b.f AS file_b, 'plant' AS k FROM (SELECT min(file_id) AS f FROM c WHERE column_name = 'plant') a, (SELECT max(file_id) AS f FROM c WHERE column_name = 'plant') b)"


def _one_join(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _roles(spark, d)
    ends = r.where("column_name = 'plant'").agg(F.min("file_id").alias("file_a"), F.max("file_id").alias("file_b"))
    return ends.select("file_a", F.lit("plant").alias("column_a"), "file_b", F.lit("plant").alias("column_b"), F.lit("custom:attribute:plant").alias("role")), r


@query("WITH " + _NAMES + ", " + _JOINS + " SELECT DISTINCT file_a, 'plant' AS column_a, file_b, 'plant' AS column_b, x.column_name AS left_column, y.column_name AS right_column, x.role AS component_role FROM j JOIN r x ON x.file_id = file_a JOIN r y ON y.file_id = file_b AND y.role = x.role WHERE x.kind <> 'additive_measure' AND x.column_name <> 'plant'")
def composite_companions(spark: SparkSession, d: str) -> DataFrame:
    """Further columns of one role on both sides of the join of the first and the last file that have a plant."""
    return g.companions(*_one_join(spark, d))


@query("WITH " + _NAMES + ", " + _JOINS + ", k AS (SELECT DISTINCT x.column_name AS l FROM j JOIN r x ON x.file_id = file_a JOIN r y ON y.file_id = file_b AND y.role = x.role WHERE x.kind <> 'additive_measure' AND x.column_name <> 'plant') SELECT file_a, file_b, CAST(1 + (SELECT count(*) FROM k) AS BIGINT) AS n_components, (SELECT count(*) FROM k) > 0 AS composite FROM j")
def join_rules(spark: SparkSession, d: str) -> DataFrame:
    joins, roles = _one_join(spark, d)
    return g.join_rules(joins, g.companions(joins, roles)).select("file_a", "file_b", F.size("components").cast("long").alias("n_components"), "composite")


_ASKED = ("net amount", "plant", "due date", "vendor payments", "supplier reference number")
_W = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: length(x) >= 2))"


@query(
    "WITH " + _NAMES + ", v AS (SELECT DISTINCT id AS file_id, 'table_name' AS signal, regexp_replace(name, '\\.[^.]*$', '') AS text FROM files UNION SELECT file_id, kind, label FROM r WHERE kind = 'entity_key' UNION SELECT file_id, 'column_name', column_name FROM c UNION SELECT file_id, 'description', ai_description FROM file_metadata WHERE ai_description IS NOT NULL AND file_id IS NOT NULL), "
    "t AS (SELECT *, " + _W.format("text") + " AS w FROM v), ta AS (SELECT *, CASE WHEN len(w) > 1 THEN array_to_string(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2), lambda x: x[1]), '') END AS short FROM t), "
    "e AS (SELECT entity, list_filter(regexp_split_to_array(entity, '[^a-z0-9]+'), lambda x: length(x) >= 2) AS e FROM (VALUES " + ", ".join(f"('{x}')" for x in _ASKED) + ") q(entity)), ea AS (SELECT *, CASE WHEN len(e) > 1 THEN array_to_string(list_transform(e, lambda x: x[1]), '') END AS es FROM e), "
    "x AS (SELECT entity, file_id, signal, CASE WHEN es IS NOT NULL AND list_contains(w, es) THEN 1.0 WHEN signal = 'table_name' THEN CASE WHEN len(list_intersect(e, w)) < len(e) THEN 0 ELSE 1 END ELSE len(list_filter(e, lambda k: list_contains(w, k) OR (length(k) BETWEEN 2 AND 5 AND k = coalesce(short, '')))) / len(e) END AS share FROM ea, ta), "
    "b AS (SELECT entity, file_id, signal, max(share) AS share FROM x GROUP BY 1, 2, 3 HAVING max(share) >= 0.5), g AS (SELECT entity, file_id, sum(share * CASE signal WHEN 'entity_key' THEN 0.55 WHEN 'table_name' THEN 0.42 WHEN 'column_name' THEN 0.28 ELSE 0.18 END) AS s, bool_or(signal = 'entity_key') AS k, bool_or(signal = 'table_name') AS t, bool_or(signal = 'column_name') AS c FROM b GROUP BY 1, 2) "
    "SELECT entity, file_id, round(least(s, CASE WHEN NOT k AND NOT t THEN 0.35 WHEN k AND NOT t THEN 0.74 ELSE 0.95 END), 6) AS score, CASE WHEN k AND NOT t THEN 'transactional_reference' WHEN k THEN 'semantic_role_match' WHEN t THEN 'table_name_match' WHEN c THEN 'column_name_match' ELSE 'description_match' END AS reason FROM g"
)
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """How sure each file is about each entity of a question, by its roles, name, columns and description."""
    roles = _roles(spark, d)
    kind = g.parse_role(F.col("role"))
    line = lambda df, signal, text: df.select("file_id", F.lit(signal).alias("signal"), text.alias("text"))
    files, meta = table(spark, d, "files").select(F.col("id").alias("file_id"), "name"), table(spark, d, "file_metadata").where("file_id is not null")
    parts = [line(files, "table_name", F.regexp_replace("name", r"\.[^.]*$", "")), line(roles.where(kind["kind"] == "entity_key"), "entity_key", g.parse_role(F.col("role"))["label"]), line(roles, "column_name", F.col("column_name")), line(meta, "description", F.col("ai_description"))]
    evidence = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return g.score_entities(spark.createDataFrame([(x,) for x in _ASKED], "entity string"), evidence)


_SOURCES = "e AS (SELECT container_id AS entity, source_system AS table_name, round(max(confidence), 6) AS confidence, CAST(count(*) AS BIGINT) AS cardinality FROM erp_classifications WHERE container_id IS NOT NULL AND source_system IS NOT NULL GROUP BY 1, 2)"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "erp_classifications").where("container_id is not null and source_system is not null").groupBy(F.col("container_id").alias("entity"), F.col("source_system").alias("table_name")).agg(F.round(F.max("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("cardinality"))


@query("WITH " + _SOURCES + ", k AS (SELECT DISTINCT table_name FROM e WHERE cardinality >= 8) SELECT e.entity, e.table_name, e.confidence, e.table_name IN (SELECT table_name FROM k) AS corroborated FROM e")
def pin_guard(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose table has a key of enough values that carries the entity's label."""
    e = _sources(spark, d)
    registry = e.select("table_name", F.lit("pk").alias("key_kind"), "cardinality", F.concat(F.lit("custom:entity_key:ct 0001 "), F.col("entity")).alias("role"))
    return g.corroborated(e.select("entity", "table_name", "confidence"), registry, min_overlap=0.3)


@query("WITH " + _SOURCES + ", s AS (SELECT * FROM e WHERE confidence >= 0.85 AND cardinality >= 2) SELECT DISTINCT t AS table_name FROM (SELECT entity, min(table_name) AS t FROM s GROUP BY 1 HAVING count(DISTINCT table_name) = 1)")
def pin_selection(spark: SparkSession, d: str) -> DataFrame:
    """The tables pinned by entities with one corroborated candidate."""
    return g.pins(_sources(spark, d).withColumn("corroborated", F.col("cardinality") >= 2))


# ---- shortlists and scores


@query("SELECT channel, key, score FROM (SELECT CASE WHEN trust_state = 'trusted' THEN 'bm25' WHEN trust_state = 'SHADOW' THEN 'vector' ELSE 'fuzzy' END AS channel, id AS key, coalesce(ingestion_confidence_score, 0.0) AS score FROM file_metadata) ORDER BY CASE channel WHEN 'bm25' THEN 1 WHEN 'vector' THEN 2 ELSE 3 END, score DESC, key LIMIT 420")
def pool_trim(spark: SparkSession, d: str) -> DataFrame:
    """A pool of candidates cut from its last channels."""
    c = F.when(F.col("trust_state") == "trusted", "bm25").when(F.col("trust_state") == "SHADOW", "vector").otherwise("fuzzy")
    return g.pool_trim(table(spark, d, "file_metadata").select(c.alias("channel"), F.col("id").alias("key"), F.coalesce("ingestion_confidence_score", F.lit(0.0)).alias("score")), most=420)


@query(
    "WITH x AS (SELECT f.id AS file_id, lower(f.name) AS p, lower(coalesce(m.ai_description, '')) AS t FROM (SELECT DISTINCT id, name FROM files) f LEFT JOIN " + _LATEST + " m ON m.file_id = f.id) "
    "SELECT file_id, round(least(0.5 + 0.3 * least(CASE WHEN contains(p, 'payments') THEN 0.3 ELSE 0 END + CASE WHEN contains(t, 'payments') THEN 0.1 ELSE 0 END + CASE WHEN contains(p, 'margin') THEN 0.3 ELSE 0 END + CASE WHEN contains(t, 'margin') THEN 0.1 ELSE 0 END, 1.0) + least(0.15 * len(list_intersect(['ap', 'payments'], list_distinct(list_filter(regexp_split_to_array(p, '[^a-z0-9]+'), lambda w: w <> '')))), 0.30) + 0.12, 0.95), 6) AS score FROM x"
)
def domain_ranking(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), F.col("name").alias("path")).distinct()
    full = f.join(_latest(spark, d, "ai_description"), "file_id", "left").select("file_id", "path", F.lit("").alias("columns"), F.col("ai_description").alias("description"), F.array(F.lit("vector")).alias("channels"))
    return g.rank_domain(full, "AP Payments", 1.0, ["payments", "margin"])


@query("WITH m AS " + _LATEST + ", k AS (SELECT file_id FROM m WHERE ingestion_confidence_score >= 0.9 UNION SELECT file_id FROM (SELECT file_id FROM m ORDER BY row_count DESC NULLS LAST, file_id LIMIT 4)), c AS (SELECT DISTINCT id AS file_id, name FROM files), d AS (SELECT file_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_id) AS r FROM c WHERE file_id IN (SELECT file_id FROM k)) WHERE r = 1) SELECT file_id FROM c WHERE file_id IN (SELECT file_id FROM d) OR (SELECT count(*) FROM d) < 3")
def summary_shortlist(spark: SparkSession, d: str) -> DataFrame:
    m = _latest(spark, d, "ingestion_confidence_score", "row_count")
    c = table(spark, d, "files").select(F.col("id").alias("file_id"), "name").distinct()
    return g.shortlist(c, m.select("file_id", F.col("ingestion_confidence_score").alias("confidence")), m.select("file_id", F.coalesce("row_count", F.lit(-1)).alias("score")), "name", 0.9).select("file_id")


@query("WITH " + _NAMES + ", a AS (SELECT file_id, list(column_name) AS cols FROM c GROUP BY 1) SELECT f.id AS file_id, (" + " OR ".join(f"contains(lower(f.name), '{w}')" for w in policy.LOOKUP_WORDS) + ") OR coalesce(len(list_filter(cols, lambda x: " + " OR ".join(f"suffix(x, '{s}')" for s in policy.NAME_SUFFIXES) + ")) > 0, FALSE) AS lookup FROM (SELECT DISTINCT id, name FROM files) f LEFT JOIN a ON a.file_id = f.id")
def lookup_files(spark: SparkSession, d: str) -> DataFrame:
    cols = _roles(spark, d).groupBy("file_id").agg(F.collect_set("column_name").alias("cols"))  # the columns of one file
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "name").distinct()
    return f.join(cols, "file_id", "left").select("file_id", g.is_lookup(F.col("name"), F.lit(None).cast("string"), F.col("cols")).alias("lookup"))


@query("WITH " + _NAMES + ", a AS (SELECT file_id, list(column_name) FILTER (kind = 'additive_measure') AS m, list(column_name) FILTER (kind <> 'additive_measure') AS dims FROM r GROUP BY 1) SELECT f.id AS file_id, round(" + " + ".join(f"coalesce(len(list_filter(m, lambda x: contains(x, '{w}'))), 0) * 1.5 + coalesce(len(list_filter(dims, lambda x: contains(x, '{w}'))), 0) + CASE WHEN contains(lower(f.name), '{w}') THEN 0.5 ELSE 0 END" for w in ("tax", "vendor")) + ", 6) AS score FROM (SELECT DISTINCT id, name FROM files) f LEFT JOIN a ON a.file_id = f.id")
def department_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well each file's columns and name fit a department."""
    kind = g.parse_role(F.col("role"))["kind"]
    cols = _roles(spark, d).groupBy("file_id").agg(F.collect_list(F.when(kind == "additive_measure", F.col("column_name"))).alias("m"), F.collect_list(F.when(kind != "additive_measure", F.col("column_name"))).alias("dims"))  # the columns of one file
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "name").distinct().join(cols, "file_id", "left")
    return f.select("file_id", F.round(g.department_score("Tax and Vendor", F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.col("m"), F.col("dims"), F.col("name")), 6).alias("score"))


@query("SELECT id, round(greatest(0.05, least(0.95, (coalesce(ingestion_confidence_score, 0) * 0.5 + CASE WHEN row_count > 0 THEN 1.0 ELSE 0.0 END * 0.3 + 0.9 * 0.2) / (CASE WHEN ingestion_confidence_score IS NULL THEN 0.0 ELSE 0.5 END + CASE WHEN row_count IS NULL THEN 0.0 ELSE 0.3 END + 0.2))), 6) AS confidence FROM file_metadata")
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    """A weighted score of the components that are known, within bounds."""
    parts = {"trust": (F.col("ingestion_confidence_score"), 0.5), "rows": (F.when(F.col("row_count").isNotNull(), (F.col("row_count") > 0).cast("double")), 0.3), "plan": (F.lit(0.9), 0.2)}
    return table(spark, d, "file_metadata").select("id", F.round(g.answer_confidence(parts), 6).alias("confidence"))


@query("SELECT event_type AS stage, CAST(count(*) AS BIGINT) AS calls, round(sum(coalesce(value, 0)), 4) AS cost, round(sum(coalesce(value, 0)) / count(*), 6) AS per_call FROM events GROUP BY 1")
def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sums of a running session's costs by stage."""
    v = F.coalesce("value", F.lit(0.0))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(v), 4).alias("cost"), F.round(F.sum(v) / F.count(F.lit(1)), 6).alias("per_call"))


@query("SELECT DISTINCT sha256(coalesce(tenant_id, '') || chr(1) || coalesce(source, '') || chr(1) || 'v3') AS key FROM documents")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Digests that tell answers of one tenant, source and version from all others."""
    return table(spark, d, "documents").select(g.cache_key(F.col("tenant_id"), F.col("source"), F.lit("v3")).alias("key")).distinct()


@query("SELECT id FROM file_metadata WHERE ai_description IS NULL OR ai_description = ''")
def empty_as_null(spark: SparkSession, d: str) -> DataFrame:
    """An empty text counts as null where the catalogue says so."""
    from sparkloom.plans import guards

    table(spark, d, "file_metadata").createOrReplaceTempView("file_metadata")
    return spark.sql(guards.empty_is_null("SELECT id FROM file_metadata WHERE ai_description = ''", {"ai_description"}))


# ---- documents


@query("WITH p AS (SELECT doc_id, CASE WHEN confidence IS NULL THEN 'failed' WHEN confidence < 0.6 THEN 'review' ELSE 'indexed' END AS status FROM chunks) SELECT doc_id, CASE WHEN bool_and(status = 'indexed') THEN 'indexed' WHEN NOT bool_or(status = 'indexed') THEN 'failed' ELSE 'partial' END AS state FROM p GROUP BY 1")
def document_status(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the states of their parts."""
    c = F.col("confidence")
    return g.fold_status(table(spark, d, "chunks").select("doc_id", F.when(c.isNull(), "failed").when(c < 0.6, "review").otherwise("indexed").alias("status")))


@query("SELECT DISTINCT id, CASE WHEN content_type <> 'application/pdf' OR content_type IS NULL THEN 'not_a_pdf:' || coalesce(nullif(content_type, ''), 'unknown') WHEN size = 0 THEN 'zero_pages' END AS reason FROM files")
def preflight(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", g.preflight(F.col("content_type"), F.lit(False), F.col("size")).alias("reason")).distinct()


@query("WITH p AS (SELECT doc_id, page_num, avg(CASE WHEN low_confidence THEN 0.0 ELSE 1.0 END) AS coverage FROM chunks GROUP BY 1, 2) SELECT doc_id, page_num, CASE WHEN coverage >= 0.7 THEN 'digital' ELSE 'scanned' END AS route FROM p")
def page_routes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "chunks").groupBy("doc_id", "page_num").agg(F.avg(F.when(F.col("low_confidence"), 0.0).otherwise(1.0)).alias("coverage"))
    return p.select("doc_id", "page_num", g.page_route(F.col("coverage")).alias("route"))


@query("WITH s AS (SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS e, n_name AS t, n_nationkey % 3 AS k FROM nation) SELECT e || '::c0' AS chunk_id, e AS element_id, CASE WHEN k = 0 THEN '| name |' || chr(10) || '| ' || t || ' |' ELSE t END AS chunk_text FROM s")
def chunk_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Elements cut by their type: a table, an image and a text."""
    k = F.pmod("n_nationkey", F.lit(3))
    content = F.when(k == 0, F.concat(F.lit("| name |\n| "), F.col("n_name"), F.lit(" |"))).otherwise(F.col("n_name"))
    e = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("element_id"), F.when(k == 0, "table").when(k == 1, "Image").otherwise("text").alias("element_type"), content.alias("content"))
    return g.dispatch_chunks(e)


_CO = "m AS (SELECT DISTINCT lower(name) AS node, tenant_id AS community FROM entities WHERE name IS NOT NULL AND tenant_id IS NOT NULL AND lower(name) IN (SELECT lower(name) FROM entities WHERE tenant_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT tenant_id) = 1)), l AS (SELECT DISTINCT min(lower(name)) OVER (PARTITION BY src_chunk_id) AS a, lower(name) AS b FROM entities WHERE name IS NOT NULL AND src_chunk_id IS NOT NULL)"


@query("WITH " + _CO + " SELECT x.community, CAST(count(*) AS BIGINT) AS n_edges FROM l JOIN m x ON l.a = x.node JOIN m y ON l.b = y.node WHERE x.community = y.community AND l.a <> l.b GROUP BY 1 HAVING count(*) >= 2")
def report_gate(spark: SparkSession, d: str) -> DataFrame:
    """Tenants' names with two links or more among themselves, by a star of each chunk's names."""
    e = table(spark, d, "entities").where("name is not null").select(F.lower("name").alias("node"), F.col("tenant_id").alias("community"), "src_chunk_id")
    one = e.where("community is not null").groupBy("node").agg(F.count_distinct("community").alias("n"), F.min("community").alias("community")).where("n = 1").select("node", "community")
    c = e.where("src_chunk_id is not null").select("src_chunk_id", "node")
    links = c.join(c.groupBy("src_chunk_id").agg(F.min("node").alias("a")), "src_chunk_id").select("a", F.col("node").alias("b"))
    return g.reportable(one, links)


@query("WITH q AS (SELECT DISTINCT lower(question) AS name FROM eval_items), t AS (SELECT name, list_distinct(list_filter(regexp_split_to_array(name, '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM q), n AS (SELECT CAST(item_id AS VARCHAR) AS entity, list_distinct(list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda x: x <> '')) AS v FROM eval_items) SELECT name, min(entity) AS entity, 1.0 AS score FROM t JOIN n ON len(list_intersect(w, v)) = len(w) AND len(w) = len(v) GROUP BY 1")
def entity_links(spark: SparkSession, d: str) -> DataFrame:
    """The best graph entity for each name by shared words."""
    e = table(spark, d, "eval_items")
    return g.link_entities(e.select(F.lower("question").alias("name")).distinct(), e.select(F.col("item_id").cast("string").alias("entity"), F.col("question").alias("label")))


@query("SELECT n, CASE WHEN n > (SELECT max(item_id) FROM eval_items) THEN 'not_found' WHEN n % 10 IN (3, 4) THEN 'conflicting' WHEN n % 3 = 0 THEN 'inferred' ELSE 'stated' END AS label FROM (SELECT DISTINCT item_id + 5 AS n FROM eval_items) WHERE n >= (SELECT min(item_id) FROM eval_items)")
def provenance_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items")
    citations = e.select(F.col("item_id").alias("n"), (F.col("item_id") % 10).alias("page"), (F.col("item_id") % 3 == 0).alias("from_card"))
    return g.provenance(e.select((F.col("item_id") + 5).alias("n")), citations, spark.createDataFrame([(3,), (4,), (4,)], "page long"))


@query("WITH need AS (SELECT DISTINCT p_brand AS question, p_size AS page FROM part), seen AS (SELECT DISTINCT p_size AS page, p_name AS text FROM part WHERE p_size <= 45), q AS (SELECT DISTINCT p_brand AS question, 'lemon' AS term FROM part), u AS (SELECT DISTINCT question FROM need WHERE page NOT IN (SELECT page FROM seen)), h AS (SELECT DISTINCT need.question FROM need JOIN seen USING (page) WHERE contains(lower(text), 'lemon')) SELECT question, question NOT IN (SELECT question FROM u) AS covered, question NOT IN (SELECT question FROM u) AND question NOT IN (SELECT question FROM h) AS diagnosed, question NOT IN (SELECT question FROM u) AND question NOT IN (SELECT question FROM h) AS proven FROM q")
def absence_proof(spark: SparkSession, d: str) -> DataFrame:
    """Whether no seen page of a brand's sizes names a word, and whether all of them were seen."""
    p = table(spark, d, "part")
    need = p.select(F.col("p_brand").alias("question"), F.col("p_size").alias("page")).distinct()
    return g.absence(p.select(F.col("p_brand").alias("question"), F.lit("Lemon").alias("term")).distinct(), p.where("p_size <= 45").select(F.col("p_size").alias("page"), F.col("p_name").alias("text")), need)


# ---- forms of SQL


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def qualify_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """QUALIFY, which Spark does not read, written as a filter over the windowed rows."""
    from sparkloom.plans import guards

    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(guards.to_spark_sql("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1"))


@query("SELECT o_orderpriority AS label, abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.2 * count(DISTINCT o_custkey) AS near_count, TRUE AS near_median FROM orders GROUP BY 1")
def approximate_aggs(spark: SparkSession, d: str) -> DataFrame:
    """Approximate counts and middles beside the exact ones, within the bound asked for."""
    exact = F.count_distinct("o_custkey")
    price = F.col("o_totalprice").cast("double")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg((F.abs(F.approx_count_distinct("o_custkey", 0.02) - exact) <= 0.2 * exact).alias("near_count"), (F.abs(F.percentile_approx(price, 0.5, 1000) - F.percentile(price, 0.5)) <= 0.02 * F.percentile(price, 0.5)).alias("near_median"))


@query("SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region UNION ALL SELECT * FROM (SELECT c_nationkey % 5 FROM customer INTERSECT ALL SELECT n_regionkey FROM nation)")
def bag_operations(spark: SparkSession, d: str) -> DataFrame:
    """EXCEPT and INTERSECT of bags, which keep repeats."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("k"))
    rest = n.exceptAll(table(spark, d, "region").select("r_regionkey"))
    return rest.unionAll(table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("k")).intersectAll(n))


@query("SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def lateral_top(spark: SparkSession, d: str) -> DataFrame:
    """The dearest order of each customer above the mean balance: a lateral subquery beside a scalar one, decorrelated to one window."""
    for t in ("customer", "orders"):
        table(spark, d, t).createOrReplaceTempView(t)
    rich = spark.sql("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 1")
    return rich.join(top, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer x WHERE x.c_nationkey = c.c_nationkey) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def correlated_subquery(spark: SparkSession, d: str) -> DataFrame:
    for t in ("customer", "orders"):
        table(spark, d, t).createOrReplaceTempView(t)
    return spark.sql("WITH c AS (SELECT * FROM customer) SELECT c_custkey FROM c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer x WHERE x.c_nationkey = c.c_nationkey) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")


GUARD_WORDS = {
    "SELECT count(*) AS unpaid FROM orders WHERE o_orderstatus_paid = 'Y'": False, "SELECT count(*) AS paid_orders FROM orders WHERE o_orderstatus_paid = 'Y'": True, "SELECT count(*) AS open_items FROM orders WHERE cleared_flag = true": False, "SELECT count(*) AS pending FROM orders WHERE approved = 'N'": True,
}


@query("SELECT * FROM (VALUES " + ", ".join(f"({quoted([k])}, {str(v).upper()})" for k, v in GUARD_WORDS.items()) + ") t(statement, ok)")
def status_alias_guard(spark: SparkSession, d: str) -> DataFrame:
    """Which aliases agree with the status their condition asks for."""
    from sparkloom.plans import guards

    return spark.createDataFrame([(k, not guards.status_conflicts(k)) for k in GUARD_WORDS], "statement string, ok boolean")


@query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT doc_id, source FROM documents WHERE source IN ('report', 'contract')) GROUP BY 1")
def authorised_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A statement on a logical table that reads its authorised parts only."""
    from sparkloom.plans import guards

    docs = table(spark, d, "documents").select("doc_id", "source").distinct()
    parts = {"DOCS": {s: docs.where(F.col("source") == s) for s in ("report", "contract", "mail", "ticket")}}
    return guards.logical_sql(spark, 'SELECT source, count(*) AS n FROM docs GROUP BY source', parts, {"report", "contract"})["rows"]


@query("SELECT container_id, a.id AS key FROM (SELECT container_id, id, row_number() OVER (PARTITION BY container_id ORDER BY coalesce(ingestion_confidence_score, 0.0) DESC, id) AS r FROM file_metadata) a WHERE r <= 4")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    """The leading four of each list, in the order they have: no second scorer is at hand."""
    w = Window.partitionBy("container_id").orderBy(F.desc(F.coalesce("ingestion_confidence_score", F.lit(0.0))), "id")
    return search.keep_order(table(spark, d, "file_metadata"), w, 4).select("container_id", F.col("id").alias("key"))
