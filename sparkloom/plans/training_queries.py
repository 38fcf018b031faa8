"""The pN_ queries of the general problems (3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators import drift, hierarchy
from sparkloom.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.build_hierarchy(table(spark, d, "folders")).select("id", "root_id", "depth")


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.build_hierarchy(table(spark, d, "folders"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.build_hierarchy(table(spark, d, "folders")))


def _followed(spark: SparkSession, d: str) -> DataFrame:
    return drift.follow(table(spark, d, "files"), table(spark, d, "file_metadata"), table(spark, d, "file_rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes_of(_followed(spark, d))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(table(spark, d, "files"), table(spark, d, "file_rows"), _followed(spark, d))


def p5_observed(spark: SparkSession, d: str) -> DataFrame:
    """Declared types beside the raw types of the values, by month and column."""
    return drift.observed_types(table(spark, d, "files"), table(spark, d, "file_metadata"), table(spark, d, "file_rows"))


def p5_columns(spark: SparkSession, d: str) -> DataFrame:
    return drift.table_columns(_followed(spark, d))


QUERIES = {"p5_found": p5_found, "p5_table": p5_table, "p5_columns": p5_columns, "p5_observed": p5_observed, "p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants}
_KEY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '^(urn:uuid:|\{{)|\}}$', '', 'g'), '^urn:uuid:', ''), '^([0-9a-f]{{8}})([0-9a-f]{{4}})([0-9a-f]{{4}})([0-9a-f]{{4}})([0-9a-f]{{12}})$', '\1-\2-\3-\4-\5')"
_NODES = (
    "nodes AS (SELECT key, id, name, parent FROM (SELECT " + _KEY.format("id") + " AS key, id, name, " + _KEY.format("parent_id") + " AS parent, "
    "row_number() OVER (PARTITION BY " + _KEY.format("id") + " ORDER BY updated_at DESC NULLS LAST, id DESC, parent_id DESC NULLS LAST, name DESC NULLS LAST) AS rn FROM folders WHERE id IS NOT NULL) WHERE rn = 1), "
    "tree AS (SELECT n.key, n.id, n.name, CASE WHEN p.key IS NULL THEN NULL ELSE n.parent END AS parent FROM nodes n LEFT JOIN nodes p ON n.parent = p.key), "
)
_WALK = (
    "down AS (SELECT key, id, id AS root_id, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL "
    "SELECT t.key, t.id, d.root_id, d.depth + 1 FROM tree t JOIN down d ON t.parent = d.key), "
    "lost AS (SELECT * FROM tree WHERE key NOT IN (SELECT key FROM down)), "
    "climb AS (SELECT key, parent AS seen FROM lost UNION SELECT c.key, l.parent FROM climb c JOIN lost l ON c.seen = l.key), "
    "on_loop AS (SELECT key FROM climb WHERE key = seen) "
)
ORACLE = {
    "p3_hierarchy": "WITH RECURSIVE " + _NODES + "down AS (SELECT key, id, name, id AS root_id, 0 AS depth, CAST([] AS VARCHAR[]) AS above, [name] AS names FROM tree WHERE parent IS NULL UNION ALL "
    "SELECT t.key, t.id, t.name, d.root_id, d.depth + 1, list_append(d.above, d.key), list_append(d.names, t.name) FROM tree t JOIN down d ON t.parent = d.key), "
    "lost AS (SELECT * FROM tree WHERE key NOT IN (SELECT key FROM down)), climb AS (SELECT key, parent AS seen FROM lost UNION SELECT c.key, l.parent FROM climb c JOIN lost l ON c.seen = l.key), on_loop AS (SELECT key FROM climb WHERE key = seen), "
    "below AS (SELECT a AS key, count(*) AS n FROM (SELECT unnest(above) AS a FROM down) GROUP BY 1) "
    "SELECT d.id, d.name, d.root_id, CAST(depth AS BIGINT) AS depth, array_to_string(names, '/') AS path, above AS ancestor_ids, CAST(coalesce(n, 0) AS BIGINT) AS n_descendants, FALSE AS on_loop FROM down d LEFT JOIN below b ON b.key = d.key UNION ALL "
    "SELECT l.id, l.name, (SELECT min(n.id) FROM climb c JOIN on_loop o ON c.seen = o.key JOIN nodes n ON n.key = o.key WHERE c.key = l.key), CAST(-1 AS BIGINT), NULL, CAST([] AS VARCHAR[]), CAST(-1 AS BIGINT), l.key IN (SELECT key FROM on_loop) FROM lost l",
    "p3_found": "WITH RECURSIVE " + _NODES + _WALK + "SELECT id, root_id, CAST(depth AS BIGINT) AS depth FROM down UNION ALL "
    "SELECT l.id, (SELECT min(n.id) FROM climb c JOIN on_loop o ON c.seen = o.key JOIN nodes n ON n.key = o.key WHERE c.key = l.key), CAST(-1 AS BIGINT) FROM lost l",
    "p3_descendants": "WITH RECURSIVE " + _NODES + "down AS (SELECT key FROM tree WHERE parent IS NULL UNION ALL SELECT t.key FROM tree t JOIN down d ON t.parent = d.key), "
    "pairs AS (SELECT t.parent AS top, t.key, t.id, 1 AS distance FROM tree t WHERE t.parent IS NOT NULL AND t.key IN (SELECT key FROM down) "
    "UNION ALL SELECT p.parent, x.key, x.id, x.distance + 1 FROM pairs x JOIN tree p ON x.top = p.key WHERE p.parent IS NOT NULL) "
    "SELECT n.key AS ancestor_id, x.id AS descendant_id, CAST(x.distance AS BIGINT) AS distance FROM pairs x JOIN nodes n ON n.key = x.top",
}
