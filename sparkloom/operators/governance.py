"""Trust, access, roles, pins and contracts of a catalogue: what may be seen, what is believed, and what a column or file is for.

Everything is a column expression or a join; nothing is gathered. Null keys match nothing, empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom import policy
from sparkloom.functions import scalars

# ---- trust


def confidence_level(score: Column, low: float = policy.LOW_CONFIDENCE, high: float = policy.HIGH_CONFIDENCE) -> Column:
    """low, medium or high; null without a score."""
    return F.when(score < low, "low").when(score < high, "medium").when(score.isNotNull(), "high")


def trust_state(level: Column, has_error: Column) -> Column:
    """QUARANTINED with an error finding or low confidence, SHADOW with medium confidence, else TRUSTED."""
    bad = F.coalesce(has_error, F.lit(False)) | (F.coalesce(level, F.lit("")) == "low")
    return F.when(bad, "QUARANTINED").when(level == "medium", "SHADOW").otherwise("TRUSTED")


def sweep_trust(files: DataFrame, findings: DataFrame) -> DataFrame:
    """file_id, state: each file of files(file_id, score) by its confidence and its own findings(file_id, severity)."""
    errors = findings.groupBy("file_id").agg(F.max(F.lower(F.trim("severity")) == "error").alias("bad"))
    return files.join(errors, "file_id", "left").select("file_id", trust_state(confidence_level(F.col("score")), F.col("bad")).alias("state"))


def drop_quarantined(hits: DataFrame, group: str, state: str) -> DataFrame:
    """Hits that are not quarantined; a group all of whose hits are is left as it is."""
    ok = F.coalesce(F.upper(state), F.lit("")) != "QUARANTINED"
    some = hits.groupBy(F.col(group).alias("_g")).agg(F.max(ok).alias("_some"))  # combined before the shuffle, so a large group is no hot task
    return hits.join(some, hits[group].eqNullSafe(some["_g"])).where(ok | ~F.col("_some")).drop("_g", "_some")


# ---- access


def of_organisation(rows: DataFrame, folders: DataFrame, organisation: str) -> DataFrame:
    """Rows whose container belongs to the organisation."""
    own = folders.where(F.col("organization_id") == organisation).select("container_id").distinct()
    return rows.join(own, "container_id", "left_semi")


def base_select(metadata: DataFrame, files: DataFrame, user: str, admin: bool = False, date_from=None, date_to=None, container: str | None = None, folder: str | None = None, domains: DataFrame | None = None) -> DataFrame:
    """Metadata rows a user may see: own or uploaded files, whose dates meet the window, in the container and folder asked for, of the domains(folder_id) allowed."""
    f = files.select(F.col("id").alias("file_id"), "owner_id", "uploaded_by_id", "folder_id").dropDuplicates(["file_id"])
    out = metadata.join(f, "file_id")
    if not admin:
        out = out.where((F.col("owner_id") == user) | (F.col("uploaded_by_id") == user))
    if date_from is not None or date_to is not None:
        out = out.where(scalars.windows_overlap(F.col("date_range_start"), F.col("date_range_end"), F.lit(date_from).cast("date"), F.lit(date_to).cast("date")))
    if container is not None:
        out = out.where(F.col("container_id") == container)
    if folder is not None:
        out = out.where(F.col("folder_id") == folder)
    return out.join(domains.select("folder_id").distinct(), "folder_id", "left_semi") if domains is not None else out


def hydrate(lean: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """The heavy columns of full for a shortlist only: lean is ranked on narrow columns first."""
    return full.join(lean.select(key).distinct(), key, "left_semi")


# ---- roles


def parse_role(role: Column) -> Column:
    """STRUCT<kind, label> of ``custom:<kind>:<label>``; nulls where it is none."""
    rx = r"^custom:([a-z_]+):(.+)$"
    hit = F.lower(F.trim(role)).rlike(rx)
    return F.struct(F.when(hit, F.regexp_extract(F.lower(F.trim(role)), rx, 1)).alias("kind"), F.when(hit, F.regexp_extract(F.trim(role), r"(?i)^custom:[a-z_]+:(.+)$", 1)).alias("label"))


def label_tokens(label: Column, least: int = 1) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(label), "[^a-z0-9]+"), lambda x: F.length(x) >= least))


def files_by_role(roles: DataFrame, entities: DataFrame, least: int = 1, floor: float | None = None) -> DataFrame:
    """file_id: files with a role label that shares a word of ``least`` letters with an entity(name, confidence) of at least ``floor``. roles(file_id, column_name, role)."""
    wanted = (entities if floor is None else entities.where(F.col("confidence") >= floor)).select(F.explode(label_tokens(F.col("name"), least)).alias("w")).distinct()
    words = roles.select("file_id", F.explode(label_tokens(parse_role(F.col("role"))["label"], least)).alias("w")).distinct()
    return words.join(wanted, "w", "left_semi").select("file_id").distinct()


def role_groups(roles: DataFrame, most_columns: int = 20) -> DataFrame:
    """file_id, kind, label, n, columns: the roles two columns or more of a file share."""
    r = roles.select("file_id", "column_name", parse_role(F.col("role")).alias("r")).where("r.kind is not null").select("file_id", "column_name", "r.kind", "r.label").distinct()
    g = r.groupBy("file_id", "kind", "label").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("column_name")).alias("columns")).where("n >= 2")  # the columns of one file
    return g.withColumn("columns", F.slice("columns", 1, most_columns))


def polarity(roles: DataFrame) -> DataFrame:
    """file_id, polarity: customer where role labels name only buyers' words, vendor where only sellers', else neutral."""
    low = F.lower(F.coalesce("role", F.lit("")))
    hit = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    g = roles.groupBy("file_id").agg(F.max(hit(policy.CUSTOMER_WORDS)).alias("c"), F.max(hit(policy.VENDOR_WORDS)).alias("v"))
    return g.select("file_id", F.when(F.col("c") & ~F.col("v"), "customer").when(F.col("v") & ~F.col("c"), "vendor").otherwise("neutral").alias("polarity"))


def entity_specs(roles: DataFrame) -> DataFrame:
    """file_id, entity_name, primary_key, metrics, dimensions, attributes, confidence: what one row of a file is, from roles(file_id, position, column_name, role). The first entity key is the primary key."""
    r = roles.select("file_id", "position", "column_name", parse_role(F.col("role")).alias("r"))
    kind = F.coalesce(F.col("r.kind"), F.lit(""))
    names = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("position", "column_name")))), lambda x: x["column_name"])
    metric, dimension = kind.isin("additive_measure", "non_additive_measure", "measure"), kind.isin("entity_key", "reference_key", "date", "attribute")
    g = r.groupBy("file_id").agg(F.min(F.when(kind == "entity_key", F.struct("position", "column_name", "r.label"))).alias("k"), names(metric).alias("metrics"), names(dimension).alias("dimensions"), names(~metric & ~dimension).alias("attributes"))  # the columns of one file
    return g.select("file_id", F.col("k.label").alias("entity_name"), F.col("k.column_name").alias("primary_key"), "metrics", "dimensions", "attributes", F.when(F.col("k").isNotNull(), policy.ENTITY_WITH_KEY).otherwise(policy.ENTITY_WITHOUT_KEY).alias("confidence"))


def companions(joins: DataFrame, roles: DataFrame) -> DataFrame:
    """joins(file_a, column_a, file_b, column_b, role) with each further pair of columns of one role on both sides: left_column, right_column, component_role. Measures are none."""
    r = roles.select("file_id", "column_name", "role", parse_role(F.col("role"))["kind"].alias("kind")).where(F.col("kind").isin("entity_key", "reference_key", "date", "attribute")).distinct()
    a = r.select(F.col("file_id").alias("file_a"), F.col("column_name").alias("left_column"), F.col("role").alias("component_role"))
    b = r.select(F.col("file_id").alias("file_b"), F.col("column_name").alias("right_column"), F.col("role").alias("component_role"))
    both = joins.join(a, "file_a").join(b, ["file_b", "component_role"])
    other = (F.col("left_column") != F.col("column_a")) & (F.col("right_column") != F.col("column_b")) & ~F.col("component_role").eqNullSafe(F.col("role"))
    return both.where(other).select("file_a", "column_a", "file_b", "column_b", "left_column", "right_column", "component_role").distinct()


def join_rules(joins: DataFrame, parts: DataFrame) -> DataFrame:
    """One record a join: its own pair of columns first, required, then the companions; composite says whether there are any."""
    key = ["file_a", "column_a", "file_b", "column_b"]
    more = parts.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("left_column", "right_column", F.lit(False).alias("required")))).alias("more"))
    own = F.array(F.struct(F.col("column_a").alias("left_column"), F.col("column_b").alias("right_column"), F.lit(True).alias("required")))
    full = joins.join(more, key, "left")
    return full.select(*key, F.when(F.col("more").isNull(), own).otherwise(F.concat(own, "more")).alias("components"), F.col("more").isNotNull().alias("composite"))


def approved_context(edges: DataFrame, shortlist: DataFrame, most: int = 12, floor: float = 0.70) -> DataFrame:
    """The surest approved edges with both ends in a shortlist(file)."""
    s = shortlist.select(F.col(shortlist.columns[0]).alias("file_a")).distinct()
    kept = edges.where((F.col("status") == "approved") & (F.col("confidence") >= floor)).join(s, "file_a", "left_semi").join(s.withColumnRenamed("file_a", "file_b"), "file_b", "left_semi")
    return kept.orderBy(F.desc("confidence"), "file_a", "column_a", "file_b", "column_b").limit(most)


# ---- pins and shortlists


def score_entities(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """entity, file_id, score, reason: how sure a file of evidence(file_id, signal, text) is about an entity(entity).

    Each signal adds its weight times the share of the entity's words its best text has; initials stand for a name of several words on either side, but for the table's
    name all words or the initials must be there. Without a role or the table's name a file is unsure, with a key role alone not sure. Words meet in equality joins.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: F.length(x) >= 2))
    initials = lambda t: F.when(F.size(t) > 1, F.array_join(F.transform(t, lambda x: F.substring(x, 1, 1)), ""))
    e = entities.select("entity").distinct().select("entity", words("entity").alias("t")).where(F.size("t") > 0).select("entity", "t", F.size("t").alias("size"), initials(F.col("t")).alias("short"))
    v = evidence.where("text is not null").select("file_id", "signal", "text").distinct().select("file_id", "signal", "text", words("text").alias("t")).withColumn("short", initials(F.col("t")))
    table = F.col("signal") == "table_name"
    keys = v.select("file_id", "signal", "text", F.explode("t").alias("w"), F.lit(True).alias("plain")).unionByName(
        v.where(~table & F.length("short").between(2, 5) & ~F.array_contains("t", F.col("short"))).select("file_id", "signal", "text", F.col("short").alias("w"), F.lit(False).alias("plain")))
    hits = e.select("entity", "size", F.explode("t").alias("w")).join(keys, "w").groupBy("entity", "size", "file_id", "signal", "text").agg(F.count(F.lit(1)).alias("n"))
    shared = hits.select("entity", "file_id", "signal", F.when(table & (F.col("n") < F.col("size")), 0.0).otherwise(F.col("n") / F.col("size")).alias("share"))
    named = e.where("short is not null").select("entity", F.col("short").alias("w")).join(keys.where("plain"), "w").select("entity", "file_id", "signal", F.lit(1.0).alias("share"))
    best = shared.unionByName(named).groupBy("entity", "file_id", "signal").agg(F.max("share").alias("share")).where(F.col("share") >= policy.EVIDENCE_OVERLAP)
    weight = F.element_at(F.create_map(*[F.lit(x) for s, w, _ in policy.EVIDENCE for x in (s, w)]), F.col("signal"))
    place = F.array_position(F.array(*[F.lit(s) for s, _, _ in policy.EVIDENCE]), F.col("signal"))
    has = lambda *names: F.max(F.col("signal").isin(*names))
    g = best.where(weight.isNotNull()).groupBy("entity", "file_id").agg(F.sum(weight * F.col("share")).alias("s"), F.min(place).alias("first"), has("entity_key", "reference_key", "table_name").alias("anchor"), has("entity_key").alias("key"), has("table_name").alias("table"))
    key_only = F.col("key") & ~F.col("table")
    score = F.least("s", F.when(~F.col("anchor"), policy.UNANCHORED_CAP).when(key_only, policy.KEY_ONLY_CAP).otherwise(policy.EVIDENCE_CAP))
    reason = F.element_at(F.array(*[F.lit(r) for _, _, r in policy.EVIDENCE]), F.when(key_only & (F.col("first") == 1), 2).otherwise(F.col("first")).cast("int"))
    return g.select("entity", "file_id", F.round(score, 6).alias("score"), reason.alias("reason"))


def corroborated(candidates: DataFrame, registry: DataFrame, min_cardinality: int = policy.EDGE_MIN_CARDINALITY, min_overlap: float = 0.5) -> DataFrame:
    """candidates(entity, table_name, confidence) with ``corroborated``: whether a key of the table with enough values has a role label that overlaps the entity. registry(table_name, key_kind, cardinality, role)."""
    keys = registry.where(F.col("key_kind").isin("pk", "fk") & (F.col("cardinality") >= min_cardinality)).select("table_name", label_tokens(parse_role(F.col("role"))["label"]).alias("l")).where("l is not null").distinct()
    e = label_tokens(F.col("entity"))
    share = F.size(F.array_intersect(e, F.col("l"))) / F.greatest(F.size(e), F.lit(1))
    hit = candidates.select("entity", "table_name").distinct().join(keys, "table_name").where(share >= min_overlap).select("entity", "table_name", F.lit(True).alias("ok")).distinct()
    return candidates.join(hit, ["entity", "table_name"], "left").withColumn("corroborated", F.coalesce("ok", F.lit(False))).drop("ok")


def pins(candidates: DataFrame, threshold: float = 0.85, guarded: bool = True) -> DataFrame:
    """table_name: tables pinned into a shortlist. Guarded, an entity pins its one corroborated candidate and none where several are; unguarded every candidate at the threshold."""
    sure = candidates.where(F.col("confidence") >= threshold)
    if not guarded:
        return sure.select("table_name").distinct()
    one = sure.where("corroborated").groupBy("entity").agg(F.count_distinct("table_name").alias("n"), F.min("table_name").alias("table_name"))
    return one.where("n = 1").select("table_name").distinct()


def pool_trim(pool: DataFrame, channels: tuple[str, ...] = ("structured", "graph", "bm25", "vector", "fuzzy"), most: int = 200) -> DataFrame:
    """pool(channel, key, score): at most ``most`` rows a question, the last channels cut first and within one the worst."""
    place = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel"))
    return pool.where(place > 0).orderBy(place, F.desc("score"), "key").limit(most)


def rank_domain(files: DataFrame, label: str, role_weight: float, words: list[str]) -> DataFrame:
    """file_id, score of files(file_id, path, columns, description, channels): the role's weight, the question's words in path, columns and description, words of the domain in the path, and the channels that found it; 0.95 at most."""
    path, cols, desc = (F.lower(F.coalesce(c, F.lit(""))) for c in ("path", "columns", "description"))
    hit = lambda c, w, x: F.when(c.contains(w.lower()), x).otherwise(0.0)
    word = F.least(reduce(lambda a, b: a + b, [hit(path, w, 0.3) + hit(cols, w, 0.2) + hit(desc, w, 0.1) for w in words], F.lit(0.0)), F.lit(1.0))
    named = F.size(F.array_intersect(label_tokens(F.lit(label)), label_tokens(path)))
    found = F.when(F.arrays_overlap("channels", F.array(F.lit("vector"), F.lit("opensearch"))), 0.12).otherwise(0.0) + F.when(F.array_contains("channels", "graph"), 0.08).otherwise(0.0)
    return files.select("file_id", F.round(F.least(F.lit(role_weight * 0.5) + word * 0.3 + F.least(named * 0.15, F.lit(0.30)) + found, F.lit(0.95)), 6).alias("score"))


def shortlist(catalog: DataFrame, resolved: DataFrame, retrieved: DataFrame, name: str, floor: float = 0.70, best: int = 4, least: int = 3) -> DataFrame:
    """catalog(file_id, ...) cut to the surely resolved files and the best retrieved ones, one of each name; the whole catalogue where fewer than ``least`` are left."""
    top = retrieved.orderBy(F.desc("score"), "file_id").limit(best).select("file_id")
    keep = resolved.where(F.col("confidence") >= floor).select("file_id").unionByName(top).distinct()
    first = Window.partitionBy(name).orderBy("file_id")
    cut = catalog.join(keep, "file_id", "left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    enough = cut.agg((F.count(F.lit(1)) >= least).alias("_ok"))
    marked = catalog.join(cut.select("file_id", F.lit(True).alias("_in")), "file_id", "left").join(F.broadcast(enough))  # one row
    return marked.where(~F.col("_ok") | F.col("_in")).drop("_in", "_ok")


def is_lookup(path: Column, description: Column, columns: Column) -> Column:
    """Whether an entry looks like a master or lookup table: by a word of its path or description, or a column that ends like a name."""
    word = reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(w) for c in (path, description) for w in policy.LOOKUP_WORDS])
    return word | F.coalesce(F.exists(columns, lambda c: reduce(lambda a, b: a | b, [F.lower(c).endswith(x) for x in policy.NAME_SUFFIXES])), F.lit(False))


def department_score(name: str, good_for: Column, description: Column, metrics: Column, dimensions: Column, file_name: Column) -> Column:
    """For each word of a department: 2 for each use it is good for that has the word, 1.5 a metric, 1 a dimension, 1 for the description, 0.5 for the file name."""
    words = sorted({w for w in scalars.plain_words(name) if w not in policy.SMALL_WORDS})
    per = lambda c, w: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x).contains(w)))
    text = lambda c, w, x: F.when(F.lower(F.coalesce(c, F.lit(""))).contains(w), x).otherwise(0.0)
    parts = [per(good_for, w) * 2.0 + text(description, w, 1.0) + per(metrics, w) * 1.5 + per(dimensions, w) * 1.0 + text(file_name, w, 0.5) for w in words]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


# ---- answers


def provenance(cited: DataFrame, citations: DataFrame, conflicts: DataFrame) -> DataFrame:
    """n, label of each cited number: not_found without a citation(n, page, from_card), conflicting on a page of conflicts(page), inferred from a card, else stated."""
    bad = conflicts.select("page", F.lit(True).alias("clash")).distinct()
    j = cited.select("n").distinct().join(citations.withColumn("known", F.lit(True)), "n", "left").join(bad, "page", "left")
    return j.select("n", F.when(F.col("known").isNull(), "not_found").when(F.col("clash"), "conflicting").when(F.col("from_card"), "inferred").otherwise("stated").alias("label"))


def absence(questions: DataFrame, chunks: DataFrame, needed: DataFrame) -> DataFrame:
    """question, covered, diagnosed, proven: an absence is proven where all needed(question, page) are among the chunks(page, text) seen and no chunk of them holds the question's term."""
    seen = chunks.select("page").distinct()
    missing = needed.join(seen, "page", "left_anti").select("question", F.lit(False).alias("covered")).distinct()
    q = questions.select("question", "term")
    held = needed.join(chunks, "page").join(q, "question").where(F.lower("text").contains(F.lower("term"))).select("question", F.lit(False).alias("diagnosed")).distinct()
    j = q.select("question").join(missing, "question", "left").join(held, "question", "left").select("question", F.coalesce("covered", F.lit(True)).alias("covered"), F.coalesce("diagnosed", F.lit(True)).alias("clear"))
    return j.select("question", "covered", (F.col("covered") & F.col("clear")).alias("diagnosed"), (F.col("covered") & F.col("clear")).alias("proven"))


def answer_confidence(parts: dict[str, tuple[Column, float]], floor: float = 0.05, ceiling: float = 0.95) -> Column:
    """A weighted mean of the components that are known, within bounds; null where none is."""
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values()])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()])
    return F.when(weight > 0, F.greatest(F.lit(floor), F.least(F.lit(ceiling), total / weight)))


def cache_key(*parts: Column) -> Column:
    """A digest of the parts; null parts count as empty, so a key never is null."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


# ---- documents


def preflight(mime: Column, encrypted: Column, pages: Column) -> Column:
    """Why a document is turned away, the first of the reasons; null where it is not."""
    return F.when(F.coalesce(encrypted, F.lit(False)), "encrypted").when(F.coalesce(mime, F.lit("")) != "application/pdf", F.concat(F.lit("not_a_pdf:"), F.coalesce(F.nullif(mime, F.lit("")), F.lit("unknown")))).when(pages == 0, "zero_pages")


def page_route(coverage: Column, least: float = policy.DIGITAL_COVERAGE) -> Column:
    return F.when(coverage >= least, "digital").otherwise("scanned")


def fold_status(pages: DataFrame, key: str = "doc_id", status: str = "status") -> DataFrame:
    """key, state: processing while a page is open, indexed if all are, failed if none is, else partial."""
    ok, settled = F.col(status) == "indexed", F.col(status).isin("indexed", "failed", "review")
    g = pages.groupBy(key).agg(F.min(F.coalesce(settled, F.lit(False))).alias("s"), F.min(F.coalesce(ok, F.lit(False))).alias("a"), F.max(F.coalesce(ok, F.lit(False))).alias("o"))
    return g.select(key, F.when(~F.col("s"), "processing").when(F.col("a"), "indexed").when(~F.col("o"), "failed").otherwise("partial").alias("state"))


def dispatch_chunks(elements: DataFrame, size: int = policy.CHUNK_TOKENS, overlap: int = policy.CHUNK_OVERLAP) -> DataFrame:
    """chunk_id (``<element>::c<n>``), element_id, chunk_text of elements(element_id, element_type, content): tables by row under their header, images by their caption, all else by sentences."""
    from sparkloom.operators.documents import chunk_text, table_chunks

    kind = F.lower(F.coalesce("element_type", F.lit("text")))
    rows = elements.where("content is not null and trim(content) <> ''")
    tables = table_chunks(rows.where(kind == "table"), "element_id", "content")
    images = rows.where(kind == "image").select("element_id", F.lit(0).cast("long").alias("chunk_no"), F.trim("content").alias("chunk_text"))
    texts = chunk_text(rows.where(~kind.isin("table", "image")), "element_id", "content", size, overlap).select("element_id", "chunk_no", "chunk_text")
    return tables.unionByName(images).unionByName(texts).select(F.concat("element_id", F.lit("::c"), F.col("chunk_no").cast("string")).alias("chunk_id"), "element_id", "chunk_text")


def reportable(members: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """community, n_edges: communities of members(node, community) with at least ``least`` edges(a, b) inside; others get no report."""
    a = members.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    b = members.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    inside = edges.select("a", "b").distinct().join(a, "a").join(b, "b").where("ca = cb and a <> b")
    return inside.groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("n_edges")).where(F.col("n_edges") >= least)


def link_entities(names: DataFrame, graph: DataFrame, floor: float = 0.50) -> DataFrame:
    """name, entity, score: the best entity of a graph(entity, label) for each name by shared words, of at least ``floor``; ties to the lesser entity."""
    n = names.select("name", label_tokens(F.col("name")).alias("t")).distinct().withColumn("size", F.size("t")).select("name", "size", F.explode("t").alias("w"))
    g = graph.select("entity", label_tokens(F.col("label")).alias("t")).distinct().withColumn("other", F.size("t")).select("entity", "other", F.explode("t").alias("w"))
    hit = n.join(g, "w").groupBy("name", "size", "entity", "other").agg(F.count(F.lit(1)).alias("k"))
    score = F.round(F.col("k") / (F.col("size") + F.col("other") - F.col("k")), 6)
    good = hit.select("name", "entity", score.alias("score")).where(F.col("score") >= floor)
    return good.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "entity")).alias("b")).select("name", "b.entity", (-F.col("b.s")).alias("score"))


# ---- driver helpers


def chart_hint(answer: str, rows: list[dict]) -> dict | None:
    """A chart for a small result: a line over time, a pie of shares, a table of many rows, else bars; none without a number."""
    if not rows:
        return None
    numbers = [c for c, v in rows[0].items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    if not numbers:
        return None
    low = answer.lower()
    kind = next((k for k, words in policy.CHART_WORDS if any(w in low for w in words)), "table" if len(rows) > 50 else "bar")
    return {"type": kind, "x_column": next(iter(rows[0])), "y_column": numbers[0]}


def predicate_hint(name: str, dtype: str, samples: list[str]) -> str:
    """A condition to start from for a column, by its name, type and samples."""
    from sparkloom.operators.cleaning import is_identifier

    low, kind = name.lower(), dtype.lower()
    if is_identifier(name):
        return f"{name} = '<value>'"
    if any(len(s) == 11 and s[2] == s[6] == "-" and s[3:6].isalpha() for s in samples):
        return f"try_to_timestamp({name}, 'dd-MMM-yyyy') BETWEEN DATE '<start>' AND DATE '<end>'"
    if "year" in low or low.endswith("_yr"):
        return f"{name} = 2024" + ("" if "int" in kind else ".0" if "float" in kind or "double" in kind else "") if any(k in kind for k in ("int", "float", "double")) else f"{name} = '2024'"
    for part, text in (("timestamp", "BETWEEN TIMESTAMP '<start>' AND TIMESTAMP '<end>'"), ("date", "BETWEEN DATE '<start>' AND DATE '<end>'")):
        if part in kind:
            return f"{name} {text}"
    return f"{name} > 0" if any(k in kind for k in ("int", "float", "double", "decimal")) else f"{name} = '<value>'"


def dictionary_columns(path: str, columns: list[str]) -> dict[str, str | None] | None:
    """The columns of a data dictionary (field, description, notes), by names, for a file whose name has the word schema; else None."""
    stem = path.rsplit("/", 1)[-1].lower()
    if "schema" not in [t for t in "".join(c if c.isalnum() else " " for c in stem).split()]:
        return None
    bare = {c: c.strip().lower().replace(" ", "_") for c in columns}

    def pick(words: tuple[str, ...], taken: set) -> str | None:
        exact = next((c for c, b in bare.items() if c not in taken and b in words), None)
        return exact or next((c for c, b in bare.items() if c not in taken and any(w in b for w in words)), None)

    field = pick(policy.DICTIONARY_FIELD, set())
    text = pick(policy.DICTIONARY_TEXT, {field})
    return {"field": field, "description": text, "notes": pick(policy.DICTIONARY_NOTES, {field, text})} if field and text else None


def slice_tables(tables: dict[str, DataFrame], column: str, values: list) -> tuple[dict[str, DataFrame], list[str]]:
    """Tables filtered by a board's slicer where they carry the column, and the names of those that do not."""
    has = {t for t, df in tables.items() if column in df.columns}
    return {t: df.where(F.col(column).isin(*values)) if t in has else df for t, df in tables.items()}, sorted(set(tables) - has)


def capacity(queued: int, seconds_each: float, sla: float, per_instance: int, least: int = 1, most: int = 40) -> int:
    """Instances that clear a queue within the time agreed, within bounds."""
    return max(least, min(most, -(-int(queued * seconds_each) // max(1, int(sla * per_instance)))))

