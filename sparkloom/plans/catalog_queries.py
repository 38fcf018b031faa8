"""Queries of catalogue, log and evaluation operators on the test tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkloom import policy
from sparkloom.operators import catalog, relate, search
from sparkloom.plans.analysis_queries import _GRAMS, _bm25_sql
from sparkloom.plans.registry import query
from sparkloom.plans.training_queries import _NODES
from sparkloom.session import durable, table
from sparkloom.sources import io

_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) AS rn FROM file_metadata) WHERE rn = 1)"


@query("WITH RECURSIVE " + _NODES + "tags AS (SELECT key, domain_tag FROM (SELECT k AS key, domain_tag, row_number() OVER (PARTITION BY k ORDER BY updated_at DESC NULLS LAST, id DESC, parent_id DESC NULLS LAST, name DESC NULLS LAST, domain_tag DESC NULLS LAST) AS rn FROM (SELECT lower(trim(id)) AS k, * FROM folders WHERE id IS NOT NULL)) WHERE rn = 1), down AS (SELECT t.key, t.id, g.domain_tag AS tag FROM tree t JOIN tags g ON t.key = g.key WHERE parent IS NULL UNION ALL SELECT t.key, t.id, coalesce(g.domain_tag, d.tag) FROM tree t JOIN down d ON t.parent = d.key JOIN tags g ON t.key = g.key) SELECT id, tag AS effective_tag FROM down UNION ALL SELECT t.id, g.domain_tag FROM tree t JOIN tags g ON t.key = g.key WHERE t.key NOT IN (SELECT key FROM down)")
def inherited_tags(spark: SparkSession, d: str) -> DataFrame:
    return catalog.effective_tags(table(spark, d, "folders"))


@query("SELECT id, CASE WHEN len(n) > 0 THEN sha256(array_to_string(list_sort(list_transform(n, lambda x: lower(trim(x)))), '|')) END AS fingerprint FROM (SELECT id, CASE WHEN json_type(columns_info, '$[0]') = 'VARCHAR' THEN json_extract_string(columns_info, '$[*]') WHEN json_extract(columns_info, '$[0].name') IS NOT NULL THEN json_extract_string(columns_info, '$[*].name') ELSE json_extract_string(columns_info, '$[*].column') END AS n FROM file_metadata)")
def schema_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return catalog.schema_fingerprints(table(spark, d, "file_metadata"))


@query("SELECT f.id, round(f.upload_duration_secs, 1) AS upload_secs, CAST(date_diff('second', f.created_at, m.ingested_at) AS BIGINT) AS ingest_secs FROM files f LEFT JOIN " + _LAST + " m ON m.file_id = f.id")
def file_timings(spark: SparkSession, d: str) -> DataFrame:
    last = catalog.newest(table(spark, d, "file_metadata").select("file_id", "ingested_at"), ["file_id"], ["ingested_at"])
    f = table(spark, d, "files").select("id", "upload_duration_secs", "created_at")
    return f.join(last, f.id == last.file_id, "left").select("id", F.round("upload_duration_secs", 1).alias("upload_secs"), (F.unix_seconds(F.col("ingested_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))).alias("ingest_secs"))


@query("WITH j AS (SELECT f.file_id, f.folder_id, m.* EXCLUDE (file_id) FROM (SELECT DISTINCT id AS file_id, folder_id FROM files) f LEFT JOIN " + _LAST + " m ON m.file_id = f.file_id) SELECT 'no_metadata' AS rule, 'error' AS severity, CAST(count(*) FILTER (ingested_at IS NULL) AS BIGINT) AS n_files FROM j UNION ALL SELECT 'zero_rows', 'warning', count(*) FILTER (row_count = 0) FROM j UNION ALL SELECT 'ingest_error', 'error', count(*) FILTER (ingest_error IS NOT NULL) FROM j UNION ALL SELECT 'low_confidence', 'warning', count(*) FILTER (ingestion_confidence_score < 0.6) FROM j UNION ALL SELECT 'no_folder', 'info', count(*) FILTER (folder_id IS NULL) FROM j UNION ALL SELECT 'repeated_metadata', 'info', count(*) FROM (SELECT file_id FROM file_metadata GROUP BY 1 HAVING count(*) > 1)")
def ingestion_audit(spark: SparkSession, d: str) -> DataFrame:
    return catalog.audit(table(spark, d, "files"), table(spark, d, "file_metadata"))


@query("SELECT f.id FROM files f LEFT JOIN (SELECT id, max(domain_tag) AS tag FROM folders GROUP BY 1) o ON f.folder_id = o.id WHERE o.tag IS NULL OR o.tag IN ('hr', 'finance')")
def domain_filter(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "folders").groupBy(F.col("id").alias("folder_id")).agg(F.max("domain_tag").alias("tag"))
    return table(spark, d, "files").select("id", "folder_id").join(tags, "folder_id", "left").where(catalog.visible(F.col("tag"), ["hr", "finance"], True)).select("id")


@query("SELECT doc_id, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY tenant_id ORDER BY ingested_at DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 5000")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """The latest documents of each tenant within a budget of characters."""
    rows = table(spark, d, "documents").select("doc_id", "tenant_id", "ingested_at", "n_chars")
    return catalog.within_budget(rows, ["tenant_id"], [F.desc("ingested_at"), "doc_id"], "n_chars", 5000).select("doc_id", "used")


@query("SELECT container_id, file_id, r AS round FROM (SELECT container_id, file_id, CAST(row_number() OVER (PARTITION BY container_id ORDER BY confidence DESC, file_id) AS BIGINT) AS r FROM erp_classifications WHERE container_id IS NOT NULL) ORDER BY r, container_id LIMIT 40")
def slot_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "erp_classifications").where("container_id is not null").select("container_id", "file_id", "confidence")
    return catalog.breadth_first(rows, "container_id", [F.desc("confidence"), "file_id"], 40).drop("confidence")


@query("SELECT mix_name, source FROM (SELECT *, row_number() OVER (PARTITION BY mix_name ORDER BY source) AS n FROM (SELECT *, round(sum(target_share) OVER (PARTITION BY mix_name ORDER BY source ROWS UNBOUNDED PRECEDING), 9) AS reach, round(0.6 * sum(target_share) OVER (PARTITION BY mix_name), 9) AS need FROM mix_targets) WHERE reach >= need) WHERE n = 1")
def weighted_pick(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mix_targets").select("mix_name", "source", (F.col("target_share") * 1e6).cast("long").alias("w"))
    return catalog.weighted_pick(rows, ["mix_name"], ["source"], "w", 0.6).select("mix_name", "source")


@query("SELECT entity_id FROM entities GROUP BY 1 HAVING bool_and(regexp_extract(src_chunk_id, '^[^:]*') IN (SELECT DISTINCT doc_id FROM sections WHERE doc_id LIKE '%7'))")
def orphan_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities that stand only in documents of a deleted set."""
    m = table(spark, d, "entities").select("entity_id", F.regexp_extract("src_chunk_id", "^[^:]*", 0).alias("doc_id"))
    return catalog.orphans(m, "entity_id", "doc_id", table(spark, d, "sections").where("doc_id like '%7'").select("doc_id"))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_chunks, round(avg(confidence), 6) AS mean_confidence, min(confidence) AS least, CAST(count(*) FILTER (confidence < 0.6) AS BIGINT) AS n_low FROM chunks GROUP BY 1")
def confidence_propagation(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    return table(spark, d, "chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(c), 6).alias("mean_confidence"), F.min(c).alias("least"), F.sum(F.when(c < policy.LOW_CONFIDENCE, 1).otherwise(0)).alias("n_low"))


@query("SELECT round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, CAST(count(*) AS BIGINT) AS n FROM (SELECT value FROM events WHERE value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 500)")
def latency_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the latest 500 samples."""
    last = table(spark, d, "events").where("value is not null").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return last.agg(p.alias("p"), F.count(F.lit(1)).alias("n")).select(*[F.round(F.col("p")[i], 4).alias(c) for i, c in enumerate(("p50", "p95", "p99"))], "n")


@query("SELECT user_id, min_by(event_type, (ts, event_id)) AS first_step, max_by(event_type, (ts, event_id)) AS last_step, CAST(count(*) AS BIGINT) AS n_steps, CAST(date_diff('microsecond', min(ts), max(ts)) AS BIGINT) AS span_us FROM events GROUP BY 1")
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_step"), F.max_by("event_type", at).alias("last_step"), F.count(F.lit(1)).alias("n_steps"), (us(F.max("ts")) - us(F.min("ts"))).alias("span_us"))


@query("SELECT user_id, round(sum(value) FILTER (event_type = 'view'), 4) AS view, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase FROM events GROUP BY 1")
def stage_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Time spent in each stage, a column a stage."""
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.sum("value"))
    return p.select("user_id", *[F.round(c, 4).alias(c) for c in ("view", "click", "purchase")])


@query("SELECT id, container_id, trust_state FROM (SELECT id, container_id, trust_state, row_number() OVER (PARTITION BY id ORDER BY 1) AS r FROM file_metadata WHERE trust_state IS NOT NULL) WHERE r = 1 AND trust_state <> 'SHADOW' UNION ALL SELECT DISTINCT id, container_id, 'renewed' FROM file_metadata WHERE trust_state = 'SHADOW'")
def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows put over those of their key: what has a new row is renewed, all else stays."""
    m = table(spark, d, "file_metadata").where("trust_state is not null").select("id", "container_id", "trust_state").dropDuplicates(["id"])
    return io.upsert(m, m.where("trust_state = 'SHADOW'").withColumn("trust_state", F.lit("renewed")), ["id"])


@query("SELECT event_id, event_type, user_id FROM events WHERE contains(lower(event_type), 'err') ORDER BY ts DESC, event_id DESC LIMIT 100")
def log_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.lower("event_type").contains("err")).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type", "user_id")


@query("SELECT DISTINCT entity_id, round(1 - levenshtein(lower(name), 'services limited') / greatest(length(name), 16), 6) AS score FROM entities WHERE name IS NOT NULL AND 1 - levenshtein(lower(name), 'services limited') / greatest(length(name), 16) >= 0.4")
def fuzzy_ratio(spark: SparkSession, d: str) -> DataFrame:
    s = catalog.likeness(F.lower("name"), F.lit("services limited"))
    return table(spark, d, "entities").where("name is not null").select("entity_id", F.round(s, 6).alias("score")).where(s >= 0.4).distinct()


@query("SELECT item_id, round(len(list_filter(expected_keywords, lambda x: contains(lower(passage), lower(x)))) / len(expected_keywords), 6) AS recall FROM eval_items")
def answer_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Share of an item's expected words its passage holds."""
    k = F.col("expected_keywords")
    return table(spark, d, "eval_items").select("item_id", F.round(F.size(F.filter(k, lambda x: F.lower("passage").contains(F.lower(x)))) / F.size(k), 6).alias("recall"))


@query("SELECT item_id, array_to_string(list_slice(p, 1, 6), '|') AS parts FROM (SELECT item_id, list_filter(list_transform(regexp_split_to_array(lower(question), '[;,?.]|\\band\\b'), lambda x: trim(regexp_replace(x, '^\\s*(?:what|which|who|when|where|how|why|is|are|was|were|did|does|do|the)\\b', ''))), lambda x: x <> '') AS p FROM eval_items)")
def question_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", F.array_join(catalog.question_parts(F.col("question")), "|").alias("parts"))


@query("SELECT f.id, f.name FROM files f LEFT JOIN (SELECT DISTINCT file_id FROM file_metadata WHERE row_count > 0) m ON m.file_id = f.id WHERE f.ingest_status = 'ingested' AND m.file_id IS NULL")
def missing_tables(spark: SparkSession, d: str) -> DataFrame:
    """Ingested files without a table that has rows."""
    have = table(spark, d, "file_metadata").where("row_count > 0").select(F.col("file_id").alias("id"))
    return table(spark, d, "files").where("ingest_status = 'ingested'").join(have, "id", "left_anti").select("id", "name")


@query("SELECT m.id, concat_ws(' ', f.name, m.ai_description, m.delimiter) AS search_text FROM file_metadata m JOIN files f ON f.id = m.file_id")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "name")
    return table(spark, d, "file_metadata").join(f, "file_id").select("id", F.concat_ws(" ", "name", "ai_description", "delimiter").alias("search_text"))


@query("SELECT tenant_id, sha256(string_agg(DISTINCT lower(trim(name)), '|' ORDER BY lower(trim(name)))) AS signature FROM entities WHERE name IS NOT NULL AND tenant_id IS NOT NULL GROUP BY 1")
def ontology_signature(spark: SparkSession, d: str) -> DataFrame:
    """An order-free signature of a tenant's terms."""
    return table(spark, d, "entities").where("name is not null and tenant_id is not null").groupBy("tenant_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("name")))), "|"), 256).alias("signature"))


@query("SELECT doc_id, date_diff('day', doc_date, DATE '2025-06-30') AS age_days FROM documents WHERE date_diff('day', doc_date, DATE '2025-06-30') >= 365")
def stale_documents(spark: SparkSession, d: str) -> DataFrame:
    age = F.datediff(F.lit("2025-06-30").cast("date"), "doc_date").cast("long")
    return table(spark, d, "documents").select("doc_id", age.alias("age_days")).where(F.col("age_days") >= policy.STALE_DAYS)


_VALID = "len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AND len(list_filter(embedding, lambda x: isnan(x))) = 0"


@query(
    "WITH b AS (SELECT card_id, row_number() OVER (ORDER BY score DESC, card_id) AS rank, 0 AS l FROM (" + _bm25_sql(["inventory", "delayed"], 30).replace("doc_id", "card_id").replace("FROM documents", "FROM (SELECT card_id, min(text) AS text FROM doc_cards GROUP BY 1)") + ")), "
    "c AS (SELECT card_id, min(embedding) AS e FROM doc_cards WHERE " + _VALID + " GROUP BY 1), v AS (SELECT card_id, row_number() OVER (ORDER BY s DESC, card_id) AS rank, 1 AS l FROM (SELECT c.card_id, list_cosine_similarity(CAST(c.e AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS s FROM c, (SELECT * FROM c ORDER BY card_id LIMIT 1) q WHERE c.card_id <> q.card_id) ORDER BY s DESC, card_id LIMIT 30), "
    "u AS (SELECT * FROM b UNION ALL SELECT * FROM v) SELECT card_id, round(sum(1.0 / (60 + rank)), 10) AS score FROM u GROUP BY 1 ORDER BY score DESC, min((l, rank)), card_id LIMIT 20"
)
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Word and vector search over cards, fused by rank."""
    cards = table(spark, d, "doc_cards").select("card_id", "text", "embedding")
    texts = cards.groupBy("card_id").agg(F.min("text").alias("text"))
    words = search.bm25(texts, ["inventory", "delayed"], "card_id", "text", 30)
    e = F.col("embedding")
    vectors = cards.where((F.size(e) == 64) & ~F.exists(e, lambda x: F.isnan(x)) & F.exists(e, lambda x: x != 0)).groupBy("card_id").agg(F.min("embedding").alias("embedding"))
    near = search.exact_topk(vectors, vectors.orderBy("card_id").limit(1), "card_id", "embedding", 30).select("card_id", "score")
    both = [durable(x) for x in (words, near)]  # two top-k lists
    return search.rrf(both, "card_id")


@query("SELECT container_id, source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (schema_fingerprint IS NULL) AS BIGINT) AS no_fingerprint, round(avg(confidence), 6) AS confidence FROM erp_classifications GROUP BY 1, 2")
def classification_summary(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "erp_classifications").groupBy("container_id", "source")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("schema_fingerprint").isNull(), 1).otherwise(0)).alias("no_fingerprint"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT column_name, kind, value FROM (SELECT 'lang' AS column_name, 'VARCHAR' AS kind, v AS value FROM (SELECT DISTINCT lang AS v FROM documents WHERE lang IS NOT NULL ORDER BY v LIMIT 5) UNION ALL SELECT 'source', 'VARCHAR', v FROM (SELECT DISTINCT source AS v FROM documents WHERE source IS NOT NULL ORDER BY v LIMIT 5))")
def column_inspector(spark: SparkSession, d: str) -> DataFrame:
    """Type and the first five distinct values of columns."""
    docs = table(spark, d, "documents")
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(F.typeof(c) == "string", "VARCHAR").otherwise(F.typeof(c)).alias("kind"), F.col(c).alias("value")) for c in ("lang", "source")]))
    w = Window.partitionBy("column_name").orderBy("value")
    return docs.select(cell.alias("x")).select("x.*").where("value is not null").distinct().withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


_FP = "SELECT file_id, fp FROM (SELECT file_id, fp, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC, fp DESC) AS rn FROM (SELECT file_id, ingested_at, CASE WHEN len(n) > 0 THEN sha256(array_to_string(list_sort(list_transform(n, lambda x: lower(trim(x)))), '|')) END AS fp FROM (SELECT *, CASE WHEN json_type(columns_info, '$[0]') = 'VARCHAR' THEN json_extract_string(columns_info, '$[*]') WHEN json_extract(columns_info, '$[0].name') IS NOT NULL THEN json_extract_string(columns_info, '$[*].name') ELSE json_extract_string(columns_info, '$[*].column') END AS n FROM file_metadata)) WHERE fp IS NOT NULL) WHERE rn = 1"


_IDENTITIES = (
    "WITH p AS (" + _FP + "), f AS (SELECT id AS file_id, container_id, upper(regexp_extract(name, '^(.*)_(?:19|20)\\d{2}[_\\-]?\\d{2}(?:_[A-Za-z]+)?\\.\\w+$', 1)) AS family, regexp_extract(name, '((?:19|20)\\d{2})[_\\-]?(\\d{2})(?:_[A-Za-z]+)?\\.', 1) || '_' || regexp_extract(name, '((?:19|20)\\d{2})[_\\-]?(\\d{2})(?:_[A-Za-z]+)?\\.', 2) AS period, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext, p.fp FROM files JOIN p ON p.file_id = files.id), "
    "s AS (SELECT container_id, family, fp, row_number() OVER (PARTITION BY container_id, family ORDER BY count(*) DESC, fp) AS r FROM f GROUP BY 1, 2, 3), n AS (SELECT f.*, CASE WHEN s.r = 1 THEN f.family ELSE f.family || '_S' || upper(substr(md5(f.fp), 1, 6)) END AS table_name FROM f JOIN s USING (container_id, family, fp)) "
    "SELECT container_id, table_name, period, file_id FROM (SELECT *, row_number() OVER (PARTITION BY container_id, table_name, period ORDER BY CASE ext WHEN 'parquet' THEN 1 WHEN 'csv' THEN 2 WHEN 'txt' THEN 3 WHEN 'xlsx' THEN 4 WHEN 'xls' THEN 5 ELSE 6 END, file_id) AS k FROM n) WHERE k = 1"
)


@query(_IDENTITIES)
def file_identities(spark: SparkSession, d: str) -> DataFrame:
    """The files each logical table is made of, split by schema, one per period."""
    return catalog.identities(table(spark, d, "files"), table(spark, d, "file_metadata"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: length(x) >= 4))"


@query("WITH q AS (SELECT item_id AS q, len(" + _TOK.format("question") + ") AS n, unnest(" + _TOK.format("question") + ") AS w FROM eval_items), e AS (SELECT DISTINCT id AS e, unnest(" + _TOK.format("ai_description") + ") AS w FROM file_metadata), h AS (SELECT q, e, round(count(*) / n, 6) AS score FROM q JOIN e ON q.w = e.w GROUP BY q, e, n) SELECT q AS item_id, e AS id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, e) AS rank FROM h) WHERE rank <= 3")
def catalog_scoring(spark: SparkSession, d: str) -> DataFrame:
    return catalog.score_catalog(table(spark, d, "eval_items"), table(spark, d, "file_metadata"), "item_id", "question", "id", "ai_description")


@query("SELECT id, max(s) AS score FROM (SELECT m.id, " + " + ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{t}') THEN {b}.0 ELSE 0.0 END" for c, b in (("f.name", 4), ("m.ai_description", 3), ("m.trust_state", 1)) for t in ("orders", "ledger", "trusted")) + " AS s FROM file_metadata m JOIN files f ON f.id = m.file_id) WHERE s > 0 GROUP BY 1 ORDER BY score DESC, id LIMIT 20")
def field_boosts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select(F.col("id").alias("file_id"), "name")
    return catalog.field_scores(table(spark, d, "file_metadata").join(f, "file_id"), "id", ["orders", "ledger", "trusted"], {"name": 4.0, "ai_description": 3.0, "trust_state": 1.0})


@query("SELECT m.id, CAST(count(*) AS BIGINT) AS n_documents FROM file_metadata m JOIN documents d ON d.doc_date BETWEEN m.date_range_start AND m.date_range_end GROUP BY 1")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents dated inside each file's range; documents are counted by day first, so a crowded day is one row in the join."""
    days = table(spark, d, "documents").groupBy("doc_date").agg(F.count(F.lit(1)).alias("k"))
    j = relate.interval_join(days, table(spark, d, "file_metadata").select("id", "date_range_start", "date_range_end"), "doc_date", "date_range_start", "date_range_end")
    return j.groupBy("id").agg(F.sum("k").alias("n_documents"))


@query("WITH m AS (SELECT o_orderpriority AS label, strftime(o_orderdate, '%m') AS month, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2, 3), c AS (SELECT label, month, n FROM m WHERE y = 1997), b AS (SELECT label, month, n FROM m WHERE y = 1996) SELECT coalesce(c.label, b.label) AS label, coalesce(c.month, b.month) AS month, CAST(c.n AS BIGINT) AS current, CAST(b.n AS BIGINT) AS baseline, CASE WHEN b.n IS NULL THEN 'added' WHEN c.n IS NULL THEN 'gone' WHEN c.n - b.n > 3 THEN 'better' WHEN c.n - b.n < -3 THEN 'worse' ELSE 'same' END AS verdict FROM c FULL JOIN b ON c.label = b.label AND c.month = b.month")
def regression_delta(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label"), F.date_format("o_orderdate", "MM").alias("month"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return catalog.compare_runs(m.where("y = 1997"), m.where("y = 1996"), ["label", "month"], "n", 3)


_B = "(SELECT file_id, ai_description AS text FROM b)"
_WORD = _bm25_sql(["margin", "delayed", "committee"]).replace("doc_id", "file_id").replace("FROM documents", "FROM " + _B)
_FUZZY = "SELECT file_id, round(len(list_intersect(" + _GRAMS.format("'delayed committee margin'") + ", " + _GRAMS.format("text") + ")) / len(" + _GRAMS.format("'delayed committee margin'") + "), 6) AS score FROM " + _B + " WHERE text IS NOT NULL"


@query(
    "WITH b AS (SELECT * FROM " + _LAST + " WHERE (date_range_end IS NULL OR date_range_end >= DATE '2021-06-01') AND (date_range_start IS NULL OR date_range_start <= DATE '2024-12-31')), ids AS (" + _IDENTITIES + "), "
    "w AS (" + _WORD + "), f AS (SELECT DISTINCT file_id, score FROM (" + _FUZZY + ") WHERE score >= 0.2 ORDER BY score DESC, file_id LIMIT 20), "
    "u AS (SELECT file_id, row_number() OVER (ORDER BY score DESC, file_id) AS rank, 0 AS l FROM (SELECT * FROM w WHERE score >= 0.05) UNION ALL SELECT file_id, row_number() OVER (ORDER BY score DESC, file_id), 1 FROM f), "
    "s AS (SELECT file_id, round(sum(1.0 / (60 + rank)), 10) AS score FROM u GROUP BY 1 ORDER BY score DESC, min((l, rank)), file_id LIMIT 20), n AS (SELECT container_id, table_name, count(DISTINCT file_id) AS n FROM ids GROUP BY 1, 2), "
    "g AS (SELECT x.file_id AS seed, y.file_id, max(0.9 * CASE WHEN n.n - 1 > 15 THEN 0.8 ELSE 1.0 END) AS score FROM ids x JOIN ids y USING (container_id, table_name) JOIN n USING (container_id, table_name) WHERE x.file_id IN (SELECT file_id FROM s) AND y.file_id NOT IN (SELECT file_id FROM s) GROUP BY 1, 2), "
    "h AS (SELECT file_id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, file_id) AS r FROM g) WHERE r <= 10 GROUP BY 1), "
    "v AS (SELECT file_id, row_number() OVER (ORDER BY score DESC, file_id) AS rank, 0 AS l FROM s UNION ALL SELECT file_id, row_number() OVER (ORDER BY score DESC, file_id), 1 FROM h), "
    "z AS (SELECT file_id, round(sum(1.0 / (60 + rank)), 10) AS score FROM v GROUP BY 1 ORDER BY score DESC, min((l, rank)), file_id LIMIT 20), "
    "t AS (SELECT z.file_id, round(z.score * greatest(0.6, 1 - 0.5 * (1 - coalesce(b.ingestion_confidence_score, 1.0))), 9) AS score, coalesce(upper(b.trust_state) = 'QUARANTINED', FALSE) AS bad FROM z LEFT JOIN b ON b.file_id = z.file_id) "
    "SELECT file_id, score FROM t WHERE NOT bad OR NOT EXISTS (SELECT 1 FROM t WHERE NOT bad)"
)
def staged_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Dates, word and trigram search over descriptions, fusion, neighbours by shared tables, fusion, trust and quarantine."""
    m = catalog.newest(table(spark, d, "file_metadata").select("file_id", "ingested_at", "ai_description", "ingestion_confidence_score", "date_range_start", "date_range_end", "trust_state"), ["file_id"], ["ingested_at"])
    ids = catalog.identities(table(spark, d, "files"), table(spark, d, "file_metadata"))
    members = ids.select(F.col("file_id").alias("node"), F.concat_ws("\u0001", "container_id", "table_name").alias("group"))
    return search.retrieve(m, "file_id", "ai_description", ["margin", "delayed", "committee"], "delayed committee margin", members, "ingestion_confidence_score", "trust_state", ("date_range_start", "date_range_end"), ("2021-06-01", "2024-12-31"))


@query("SELECT category, round(avg(CAST(must_cite AS INT)), 6) AS cite_rate, round(avg(CAST(expect_refusal AS INT)), 6) AS refusal_rate, CAST(count(DISTINCT question) AS BIGINT) AS n_questions FROM eval_items GROUP BY 1")
def evaluation_rates(spark: SparkSession, d: str) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return table(spark, d, "eval_items").groupBy("category").agg(rate("must_cite").alias("cite_rate"), rate("expect_refusal").alias("refusal_rate"), F.count_distinct("question").alias("n_questions"))


@query("SELECT container_id, a AS date_from, b AS date_to FROM (SELECT container_id, min(date_range_start) AS a, max(date_range_end) AS b, sum(row_count) AS n FROM file_metadata WHERE date_range_start IS NOT NULL GROUP BY 1) ORDER BY n DESC, container_id LIMIT 1")
def board_window(spark: SparkSession, d: str) -> DataFrame:
    """The date range of the largest dated container."""
    g = table(spark, d, "file_metadata").where("date_range_start is not null").groupBy("container_id").agg(F.min("date_range_start").alias("date_from"), F.max("date_range_end").alias("date_to"), F.sum("row_count").alias("n"))
    return g.orderBy(F.desc("n"), "container_id").limit(1).drop("n")
