"""Queries of scalar functions, sources and the smaller document, board and graph operators on the test tables, beside their SQL."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.functions import scalars
from sparkloom.operators import board, catalog, cleaning, documents, knowledge, search
from sparkloom.plans import guards
from sparkloom.plans.analysis_queries import _EDGES, _FPS, _OVERLAP, _REG, _edges
from sparkloom.plans.registry import query
from sparkloom.sources import io
from sparkloom.session import table

_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: length(x) >= {1}))"


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: x[1]), '') AS acronym, round(coalesce(len(list_intersect(" + _TOK.format("p_name", 2) + ", " + _TOK.format("p_type", 2) + ")) / nullif(len(" + _TOK.format("p_name", 2) + "), 0), 0), 9) AS overlap FROM part")
def name_functions(spark: SparkSession, d: str) -> DataFrame:
    """Slugs, acronyms and shares of common words."""
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", scalars.slug(F.concat(n, F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"), scalars.acronym(n).alias("acronym"), F.round(scalars.token_overlap(scalars.tokens(n), scalars.tokens(F.col("p_type"))), 9).alias("overlap"))


@query("SELECT a.vec_id, round(greatest(0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b")
def cosine_to_first(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(first)).select("vec_id", F.round(scalars.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))  # one row is broadcast


@query("SELECT DISTINCT 'custom:' || c || ':' || n AS role, c AS kind, n AS label FROM (SELECT lower(r_name) AS c, lower(n_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey)")
def role_parse(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("custom:"), F.lower("r_name"), F.lit(":"), F.lower("n_name")).alias("role"))
    return r.select("role", scalars.role_kind(F.col("role")).alias("x")).select("role", "x.kind", "x.label").distinct()


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS DOUBLE) * 1000 WHEN 1 THEN CAST(o_custkey AS DOUBLE) * 1000000 ELSE CAST(o_custkey AS DOUBLE) END AS amount FROM orders")
def prose_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The first number of a sentence, its thousands and millions written out."""
    unit = F.element_at(F.array(F.lit("k"), F.lit(" M"), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("It came to "), F.format_number("o_custkey", 0), unit, F.lit(" in the end."))
    return table(spark, d, "orders").select("o_orderkey", scalars.prose_number(text).alias("amount"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|') AND NOT regexp_matches(x, '^[\\s|:\\-]+$'))) AS BIGINT) AS n_rows FROM documents WHERE text IS NOT NULL")
def table_row_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the markdown tables in each document."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(scalars.table_rows(F.col("text"))).cast("long").alias("n_rows"))


_T = "SELECT n_nationkey AS k, '| name | region |' || chr(10) || '|---|---|' || chr(10) || '| ' || n_name || ' | ' || r_name || ' |' AS t FROM nation JOIN region ON n_regionkey = r_regionkey"


@query("SELECT k, CAST(0 AS BIGINT) AS chunk_no, '| name | region |' || chr(10) || split_part(t, chr(10), 3) AS chunk_text FROM (" + _T + ")")
def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each row of a table under the table's header."""
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return documents.table_chunks(j.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("| name | region |\n|---|---|\n| "), "n_name", F.lit(" | "), "r_name", F.lit(" |")).alias("t")), "k", "t")


@query("SELECT r_regionkey AS k, '| ' || r_name || ' | ' || r_name || ' |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || CAST(n_nationkey AS VARCHAR) || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, r_name")
def grid_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A grid of cells as a table, a spanning head repeated."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    head = r.select(F.col("r_regionkey").alias("k"), F.lit(-1).cast("bigint").alias("row"), F.lit(0).alias("col"), F.lit(1).alias("row_span"), F.lit(2).alias("col_span"), F.col("r_name").alias("content"))
    cells = n.select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").cast("bigint").alias("row"), F.explode(F.array(F.struct(F.lit(0).alias("col"), F.col("n_name").alias("c")), F.struct(F.lit(1).alias("col"), F.col("n_nationkey").cast("string").alias("c")))).alias("x")).select("k", "row", "x.col", F.lit(None).cast("int").alias("row_span"), F.lit(None).cast("int").alias("col_span"), F.col("x.c").alias("content"))
    return catalog.grid_markdown(head.unionByName(cells), "k")


@query(
    "WITH RECURSIVE l AS (SELECT doc_id AS g, chunk_id AS o, n_chars AS t, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS i FROM (SELECT DISTINCT doc_id, chunk_id, n_chars FROM chunks)), "
    "w AS (SELECT g, o, i, 0 AS b, 1 AS n, t AS used FROM l WHERE i = 1 UNION ALL SELECT l.g, l.o, l.i, CASE WHEN w.n >= 4 OR w.used + l.t > 900 THEN w.b + 1 ELSE w.b END, CASE WHEN w.n >= 4 OR w.used + l.t > 900 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 4 OR w.used + l.t > 900 THEN l.t ELSE w.used + l.t END FROM w JOIN l ON l.g = w.g AND l.i = w.i + 1) SELECT g, o, CAST(b AS BIGINT) AS batch_no FROM w"
)
def token_batches(spark: SparkSession, d: str) -> DataFrame:
    """A document's chunks in batches of four chunks and nine hundred letters at most."""
    c = table(spark, d, "chunks").select(F.col("doc_id").alias("g"), F.col("chunk_id").alias("o"), F.col("n_chars").alias("t")).distinct()
    return catalog.batches(c, "g", "o", "t", 4, 900)


@query("SELECT doc_id, page_num, CASE WHEN max(n_chars) > 3000 THEN 'scanned' WHEN sum(n_chars) < 200 THEN 'scanned' WHEN count(*) > 12 THEN 'complex' ELSE 'native' END AS kind FROM chunks GROUP BY 1, 2")
def page_classes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "chunks").groupBy("doc_id", "page_num").agg(F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("most"))
    return p.select("doc_id", "page_num", catalog.page_class(F.col("chars"), 200, F.col("n") > 12, F.col("most") > 3000).alias("kind"))


@query("SELECT chunk_id FROM (SELECT chunk_id, tenant_id, CAST(regexp_extract(chunk_id, '(\\d+)$', 1) AS BIGINT) % 3 AS k FROM chunks) WHERE tenant_id = 'tn-0007' AND k IN (0, 1)")
def chunk_access(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a tenant whose access list names the user, a group of theirs, or all."""
    k = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("long") % 3
    acl = F.when(k == 0, '{"users": ["u1"], "groups": []}').when(k == 1, '{"groups": ["g2", "g9"]}').otherwise('{"users": ["other"], broken')
    return search.acl_filter(table(spark, d, "chunks").withColumn("acl", acl), "u1", ["g2"], "tn-0007")[0].select("chunk_id")


@query("WITH h AS (SELECT card_id AS id, round(abs(CAST(embedding[1] AS DOUBLE)), 6) AS score FROM (SELECT card_id, min(embedding) AS embedding FROM doc_cards WHERE len(embedding) > 0 AND NOT isnan(embedding[1]) GROUP BY 1)), s AS (SELECT DISTINCT card_id AS card, doc_id AS chunk FROM doc_cards WHERE tenant_id = 'tn-0007') SELECT chunk, max(score) AS score FROM (SELECT s.chunk, h.score FROM h JOIN s ON h.id = s.card UNION ALL SELECT id, score FROM h WHERE id NOT IN (SELECT card FROM s)) GROUP BY 1")
def quotable_sources(spark: SparkSession, d: str) -> DataFrame:
    """Hits on one tenant's cards replaced by what they were made of."""
    cards = table(spark, d, "doc_cards")
    hits = cards.where((F.size("embedding") > 0) & ~F.isnan(F.get("embedding", F.lit(0)))).groupBy("card_id").agg(F.min("embedding").alias("e")).select(F.col("card_id").alias("id"), F.round(F.abs(F.get("e", F.lit(0)).cast("double")), 6).alias("score"))
    return knowledge.quotable(hits, cards.where("tenant_id = 'tn-0007'").select(F.col("card_id").alias("card"), F.col("doc_id").alias("chunk")).distinct())


@query("WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[]))) AS s FROM embeddings, q), a AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank, vec_id % 2 AS l FROM s WHERE s >= 0.3 AND vec_id % 2 = 0 ORDER BY s DESC, vec_id LIMIT 20), b AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank, 1 AS l FROM s WHERE s >= 0.3 ORDER BY s DESC, vec_id LIMIT 20), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT vec_id, round(sum(1.0 / (60 + rank)), 10) AS score FROM u GROUP BY 1 ORDER BY score DESC, min((l, rank)), vec_id LIMIT 20")
def multi_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """Two legs that name the same keys, one with every other vector, fused by rank."""
    e = table(spark, d, "embeddings")
    v = e.orderBy("vec_id").first()["embedding"]
    return knowledge.multi_vector({"even": e.where("vec_id % 2 = 0"), "all": e}, list(v), "vec_id")


@query("WITH t AS (SELECT DISTINCT tenant_id AS tenant, lower(trim(name)) AS term FROM entities WHERE name IS NOT NULL AND tenant_id IS NOT NULL), n AS (SELECT tenant, sha256(string_agg(term, '|' ORDER BY term)) AS s FROM t GROUP BY 1) SELECT tenant, CAST(CASE WHEN tenant < 'tn-0100' THEN 4 WHEN tenant < 'tn-0200' THEN 8 ELSE 1 END AS BIGINT) AS version, s AS signature FROM n")
def next_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of tenants' terms: unchanged, changed and new ones."""
    terms = table(spark, d, "entities").where("name is not null and tenant_id is not null").select(F.col("tenant_id").alias("tenant"), F.col("name").alias("term"))
    sign = terms.groupBy("tenant").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("term")))), "|"), 256).alias("signature"))
    known = sign.where("tenant < 'tn-0100'").select("tenant", F.lit(4).cast("long").alias("version"), "signature").unionByName(sign.where("tenant >= 'tn-0100' and tenant < 'tn-0200'").select("tenant", F.lit(7).cast("long").alias("version"), F.lit("old").alias("signature")))
    return knowledge.next_version(known, terms)


@query("WITH m AS (SELECT DISTINCT lower(name) AS entity, src_chunk_id AS chunk, regexp_extract(src_chunk_id, '^[^:]*') AS doc_id FROM entities WHERE name IS NOT NULL AND src_chunk_id IS NOT NULL) SELECT DISTINCT entity FROM m WHERE doc_id NOT LIKE '%3'")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Names that still have a mention when documents go."""
    m = table(spark, d, "entities").where("name is not null and src_chunk_id is not null").select(F.lower("name").alias("entity"), F.col("src_chunk_id").alias("chunk"), F.regexp_extract("src_chunk_id", "^[^:]*", 0).alias("doc_id")).distinct()
    gone = m.where("doc_id like '%3'").select("doc_id")
    _, kept, _ = knowledge.delete_documents(gone, m.select("doc_id", "chunk").distinct(), m.select("entity", "chunk"), m.select(F.col("entity").alias("a"), F.col("entity").alias("b")))
    return kept.select("entity").distinct()


@query("WITH " + _FPS + ", " + _REG + ", " + _OVERLAP + ", " + _EDGES + ", u AS (SELECT 'all' AS widget, t FROM (SELECT DISTINCT file_name AS t FROM cells)), s AS (SELECT DISTINCT least(file_a, file_b) AS ta, greatest(file_a, file_b) AS tb FROM edges WHERE overlap >= 0.5 AND relationship_type <> 'many_to_many') SELECT 'all' AS widget, a.t AS ta, b.t AS tb FROM u a JOIN u b ON a.t < b.t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.ta = a.t AND s.tb = b.t)")
def unsafe_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tables a widget may not put side by side: no approved join of enough overlap and a known side."""
    e = _edges(spark, d)
    used = spark.createDataFrame([("all", t) for t in ("orders", "lineitem", "customer", "supplier", "part", "nation", "region")], "widget string, table_name string")
    return board.unsafe_pairs(used, e)


@query("SELECT n_name || ' is in ' || r_name AS text, CASE WHEN length(n_name) >= length(r_name) THEN n_name || '|' || r_name ELSE r_name || '|' || n_name END AS forms FROM (SELECT upper(replace(n_name, '_', '')) AS n_name, upper(r_name) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE length(n_name) <> length(r_name)")
def surface_forms(spark: SparkSession, d: str) -> DataFrame:
    """Names in a question, the longest first."""
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.upper(F.replace("n_name", F.lit("_"), F.lit(""))).alias("n"), F.upper("r_name").alias("r"))
    text = F.concat("n", F.lit(" is in "), "r")
    return j.where("length(n) <> length(r)").select(text.alias("text"), F.array_join(catalog.surface_forms(text), "|").alias("forms"))


@query("SELECT n_nationkey AS k, 'who sells in N' || CAST(n_nationkey AS VARCHAR) || ' and RX' || ' ' || n_name AS expanded FROM nation")
def glossary_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the long forms of the short ones they use."""
    n = table(spark, d, "nation")
    g = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("short"), F.col("n_name").alias("long_form"))
    return catalog.expand_terms(n.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("who sells in N"), F.col("n_nationkey").cast("string"), F.lit(" and RX")).alias("q")), "k", "q", g)


# ---- guards that run


@query("SELECT c_mktsegment, CAST(sum(o_totalprice) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def guarded_sql(spark: SparkSession, d: str) -> DataFrame:
    """A statement through the guards, its approved join and the cap."""
    for t in ("orders", "customer"):
        table(spark, d, t).createOrReplaceTempView(t)
    out = guards.run_sql(spark, "SELECT c_mktsegment, CAST(sum(o_totalprice) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", approved={(("customer", "c_custkey"), ("orders", "o_custkey"))})
    return spark.createDataFrame([(r["c_mktsegment"], r["total"]) for r in out["rows"]], "c_mktsegment string, total double")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(TRY_CAST(o_orderpriority AS INTEGER)) AS BIGINT) AS numbers FROM orders")
def try_cast_repair(spark: SparkSession, d: str) -> DataFrame:
    """A failing cast mended to a trying one, the same asked for."""
    table(spark, d, "orders").createOrReplaceTempView("orders")
    out = guards.run_sql(spark, "SELECT count(*) AS n, count(cast(o_orderpriority AS int)) AS numbers FROM orders")
    return spark.createDataFrame([(r["n"], r["numbers"]) for r in out["rows"]], "n long, numbers long")


@query("SELECT * FROM (VALUES ('SELECT * FROM orders LIMIT 5', TRUE), ('SELECT o_custkey AS limit_ FROM orders', FALSE), ('SELECT * FROM (SELECT * FROM orders LIMIT 1) t', FALSE)) t(statement, limited)")
def automatic_limit(spark: SparkSession, d: str) -> DataFrame:
    """Which statements are limited and which get a limit, read off the plan."""
    table(spark, d, "orders").createOrReplaceTempView("orders")
    q = ["SELECT * FROM orders LIMIT 5", "SELECT o_custkey AS limit_ FROM orders", "SELECT * FROM (SELECT * FROM orders LIMIT 1) t"]
    return spark.createDataFrame([(x, guards.has_limit(spark, x)) for x in q], "statement string, limited boolean")


# ---- sources


def _folder() -> str:
    return os.path.join(tempfile.gettempdir(), f"sparkloom-sources-{os.getuid()}")


@query("SELECT CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS name, CAST(n_nationkey AS VARCHAR) AS nationkey, n_name || ', ' || CAST(n_regionkey AS VARCHAR) AS note FROM nation")
def text_table(spark: SparkSession, d: str) -> DataFrame:
    """A text file with a title, a blank line and rows with an empty first cell, read without loss. The file is a few rows written by the driver."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    path = os.path.join(_folder(), "nations.csv")
    os.makedirs(_folder(), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("Nations of the world;;\n\nname;nationkey;note\n" + "".join(f"{'' if r.n_nationkey % 4 == 0 else r.n_name};{r.n_nationkey};\"{r.n_name}, {r.n_regionkey}\"\n" for r in rows))
    return io.read_text_table(spark, "file://" + path)


@query("SELECT DISTINCT 'orders' AS table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS kind FROM (SELECT column_name, column_type AS data_type FROM (DESCRIBE SELECT * FROM orders))")
def introspection(spark: SparkSession, d: str) -> DataFrame:
    """Columns and types of a source."""
    return io.describe_tables({"orders": table(spark, d, "orders")})


@query("SELECT id FROM file_metadata WHERE id IN (SELECT id FROM file_metadata WHERE row_count > 0) AND NOT (delimiter = ';') OR delimiter IS NULL AND row_count > 0")
def clean_probe(spark: SparkSession, d: str) -> DataFrame:
    """Files whose probe says they need no cleaning: comma or none, rows, no error in the head."""
    m = table(spark, d, "file_metadata")
    return m.where(cleaning.already_clean(F.lit("UTF-8"), F.coalesce("delimiter", F.lit(",")), F.lit(0), F.col("row_count") > 0, F.lit(0), allowed=(",", "\t", "|"))).select("id")
