"""Catalogue operators over files, metadata, folders and logs: newest rows, inherited tags, audits, timings, budgets, picks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions import scalars
from sparkloom.operators import drift, hierarchy


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: that with the greatest order columns; a map-side combined maximum, no sort and no window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in [*order, *rest]])


def effective_tags(folders: DataFrame) -> DataFrame:
    """id, effective_tag: a folder's own tag or that of the nearest folder above it that has one; a folder on a loop has only its own."""
    key = hierarchy.canonical_id(F.col("id"))
    state = folders.where("id is not null").select(key.alias("key"), F.struct("updated_at", "id", "parent_id", "name", "domain_tag").alias("r")).groupBy("key").agg(F.max("r").alias("r")).select("key", F.col("r.domain_tag").alias("tag"))
    tree = hierarchy.build_hierarchy(folders).select("id", F.posexplode(F.concat("ancestor_ids", F.array(hierarchy.canonical_id(F.col("id"))))).alias("level", "key"))
    tagged = tree.join(state.where("tag is not null"), "key", "left")
    return tagged.groupBy("id").agg(F.max_by("tag", F.when(F.col("tag").isNotNull(), F.col("level"))).alias("effective_tag"))


def schema_fingerprints(metadata: DataFrame) -> DataFrame:
    """id, fingerprint: SHA-256 of a file's sorted column names in lower case; null without columns. Order and types do not matter."""
    cols = drift.declared_columns(F.col("columns_info"))
    names = F.array_sort(F.transform(cols, lambda c: F.lower(F.trim(c["name"]))))
    return metadata.select("id", F.when(F.size(cols) > 0, F.sha2(F.array_join(names, "|"), 256)).alias("fingerprint"))


def visible(folder_tag: Column, allowed: list[str], untagged: bool) -> Column:
    """Whether a tag may be seen; ``untagged`` says whether files without a tag are shown (retrieval) or hidden (catalogue)."""
    return F.when(folder_tag.isNull(), F.lit(untagged)).otherwise(folder_tag.isin(*allowed))


def within_budget(df: DataFrame, keys: list[str], order: list, size: str, budget: int, parts: int = 32) -> DataFrame:
    """Each group's leading rows whose sizes (none negative) sum to at most the budget; a null size adds nothing, and rows before the first size are left out.

    A group is cut into parts first: a row within the budget of its group is within that of its part, so a large group is sorted in parts and few of its rows meet.
    """
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    running = lambda *by: F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    some = df.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(parts)))
    few = some.withColumn("_used", running(*keys, "_part")).where(F.col("_used").isNull() | (F.col("_used") <= budget)).drop("_used", "_part")
    return few.withColumn("used", running(*keys)).where(F.col("used") <= budget)


def breadth_first(df: DataFrame, group: str, order: list, slots: int) -> DataFrame:
    """The best of each group, then the second best of each, until the slots are filled."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("round", F.row_number().over(w).cast("long")).orderBy("round", group).limit(slots)


def weighted_pick(df: DataFrame, keys: list[str], order: list, weight: str, token: float) -> DataFrame:
    """In each group the first row at which the cumulative weight passes ``token`` of the whole."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    crossed = df.withColumn("reach", F.sum(weight).over(w)).withColumn("need", token * F.sum(weight).over(whole)).where("reach >= need")
    first = Window.partitionBy(*keys).orderBy(*order)
    return crossed.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "need", "reach")


def audit(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """rule, severity, n_files: what is wrong with a catalogue, each rule over all files."""
    last = newest(metadata.select("file_id", "ingested_at", "row_count", "ingest_error", "ingestion_confidence_score", "columns_info"), ["file_id"], ["ingested_at"])
    j = files.select(F.col("id").alias("file_id"), "folder_id").distinct().join(last, "file_id", "left")
    repeated = metadata.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rules = [("no_metadata", "error", F.col("ingested_at").isNull()), ("zero_rows", "warning", F.col("row_count") == 0), ("ingest_error", "error", F.col("ingest_error").isNotNull()), ("low_confidence", "warning", F.col("ingestion_confidence_score") < 0.6), ("no_folder", "info", F.col("folder_id").isNull())]
    one = j.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, _, c in rules])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.col(n).cast("long").alias("n_files")) for n, s, _ in rules])).alias("x")).select("x.*")
    return out.unionByName(repeated.agg(F.count(F.lit(1)).alias("n_files")).select(F.lit("repeated_metadata").alias("rule"), F.lit("info").alias("severity"), "n_files"))


def orphans(mentions: DataFrame, key: str, document: str, deleted: DataFrame) -> DataFrame:
    """Keys all of whose mentions are in deleted documents."""
    gone = deleted.select(F.col(deleted.columns[0]).alias(document), F.lit(1).alias("gone")).distinct()
    return mentions.join(gone, document, "left").groupBy(key).agg(F.min(F.coalesce("gone", F.lit(0))).alias("gone")).where("gone = 1").select(key)


def batches(df: DataFrame, group: str, order: str, tokens: str, max_rows: int, budget: int) -> DataFrame:
    """group, order, batch_no: rows packed in order into batches of at most max_rows rows and budget tokens; an oversized row is a batch of its own.

    A fold with a reset cannot be a window; each group is one task's, so the group should be a bounded unit such as a document.
    """
    types = dict(df.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        n, used, no, out = 0, 0, 0, []
        for t in g[tokens].fillna(0):
            if n and (n >= max_rows or used + t > budget):
                no, n, used = no + 1, 0, 0
            n, used = n + 1, used + t
            out.append(no)
        return pd.DataFrame({group: g[group], order: g[order], "batch_no": out})

    return df.select(group, order, tokens).groupBy(group).applyInPandas(run, f"{group} {types[group]}, {order} {types[order]}, batch_no long")


def column_order(lefts: list[float], most: int = 4) -> list[int]:
    """The text column of each element by its left edge: one-dimensional k-means, the number of columns by the best silhouette, columns from left to right."""
    xs = sorted(set(lefts))
    best, labels = 0.5, dict.fromkeys(xs, 0)
    for k in range(2, min(most, len(xs)) + 1):
        centres = [xs[int((i + 0.5) * len(xs) / k)] for i in range(k)]
        for _ in range(30):
            own = {x: min(range(k), key=lambda i: abs(x - centres[i])) for x in xs}
            moved = [([x for x in lefts if own[x] == i] or [centres[i]]) for i in range(k)]
            new = [sum(m) / len(m) for m in moved]
            if new == centres:
                break
            centres = new
        groups = [[x for x in lefts if own[x] == i] for i in range(k)]
        if min(map(len, groups)) == 0:
            continue
        total = 0.0
        for x in lefts:
            mine = groups[own[x]]
            a = sum(abs(x - y) for y in mine) / max(1, len(mine) - 1)
            b = min(sum(abs(x - y) for y in g) / len(g) for i, g in enumerate(groups) if i != own[x])
            total += 0.0 if len(mine) == 1 else (b - a) / max(a, b, 1e-9)
        if total / len(lefts) > best + 1e-9:
            best, labels = total / len(lefts), own
    return [labels[x] for x in lefts]


def grid_markdown(cells: DataFrame, key: str) -> DataFrame:
    """key, markdown from cells(row, col, row_span, col_span, content): spanned places repeat the content."""
    spread = cells.select(key, "content", F.explode(F.sequence(F.col("row"), F.col("row") + F.coalesce("row_span", F.lit(1)) - 1)).alias("r"), "col", "col_span").select(key, "content", "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.coalesce("col_span", F.lit(1)) - 1)).alias("c"))
    lines = spread.groupBy(key, "r").agg(F.array_sort(F.collect_list(F.struct("c", F.coalesce("content", F.lit("")).alias("t")))).alias("x")).select(key, "r", F.concat(F.lit("| "), F.array_join(F.transform("x", lambda v: v["t"]), " | "), F.lit(" |")).alias("line"), F.concat(F.lit("|"), F.array_join(F.transform("x", lambda v: F.lit("---")), "|"), F.lit("|")).alias("rule"))
    all_ = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("l"), F.min_by("rule", "r").alias("rule"))
    body = F.transform("l", lambda v: v["line"])
    return all_.select(key, F.array_join(F.concat(F.slice(body, 1, 1), F.array("rule"), F.slice(body, 2, 1_000_000)), "\n").alias("markdown"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def question_parts(c: Column, most: int = 6) -> Column:
    """A question cut at marks and ``and``, without question words, distinct, at most ``most``."""
    parts = F.split(F.lower(c), r"[;,?.]|\band\b")
    bare = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:what|which|who|when|where|how|why|is|are|was|were|did|does|do|the)\b", "")))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: x != "")), 1, most)


# Formats of one period's file, the one that is kept first.
FORMATS = ("parquet", "csv", "txt", "xlsx", "xls")


def identities(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """container_id, table_name, period, file_id: the files that make up each logical table.

    Files of one name family merge only with the same set of column names: the set most files have keeps the name (ties: the lesser fingerprint),
    others get ``_S`` and six figures of theirs. A period in several formats is kept once, by FORMATS, then by the lesser id. Files without columns or date are left out.
    """
    fp = schema_fingerprints(metadata.select(F.struct("file_id", "ingested_at").alias("id"), "columns_info")).where("fingerprint is not null").select("id.*", "fingerprint")
    last = newest(fp, ["file_id"], ["ingested_at"])
    f = files.select(F.col("id").alias("file_id"), "container_id", scalars.logical_table(F.col("name")).alias("family"), scalars.file_period(F.col("name")).alias("period"), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).alias("ext")).where("period is not null").distinct().join(last.select("file_id", "fingerprint"), "file_id")
    sets = f.groupBy("container_id", "family", "fingerprint").agg(F.count_distinct("file_id").alias("n"))
    main = sets.groupBy("container_id", "family").agg(F.min_by("fingerprint", F.struct((-F.col("n")).alias("n"), "fingerprint")).alias("main"))
    named = f.join(main, ["container_id", "family"]).withColumn("table_name", F.when(F.col("fingerprint") == F.col("main"), F.col("family")).otherwise(F.concat("family", F.lit("_S"), F.upper(F.substring(F.md5("fingerprint"), 1, 6)))))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in FORMATS]), F.col("ext")), F.lit(0)), F.lit(len(FORMATS) + 1))
    return named.groupBy("container_id", "table_name", "period").agg(F.min_by("file_id", F.struct(rank.alias("r"), "file_id")).alias("file_id"))


def score_catalog(questions: DataFrame, entries: DataFrame, question: str, q_text: str, entry: str, e_text: str, top: int = 3, least: int = 4) -> DataFrame:
    """question, entry, score, rank: entries by the share of the question's words (of ``least`` letters or more) they hold. Words meet in an equality join."""
    q = questions.select(F.col(question).alias("q"), scalars.tokens(F.col(q_text), least).alias("w")).where(F.size("w") > 0).select("q", F.size("w").alias("n"), F.explode("w").alias("w"))
    e = entries.select(F.col(entry).alias("e"), F.explode(scalars.tokens(F.col(e_text), least)).alias("w")).distinct()
    hit = q.join(e, "w").groupBy("q", "e", "n").agg(F.count(F.lit(1)).alias("k")).select("q", "e", F.round(F.col("k") / F.col("n"), 6).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "e")
    return hit.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select(F.col("q").alias(question), F.col("e").alias(entry), "score", "rank")


def field_scores(df: DataFrame, key: str, terms: list[str], boosts: dict[str, float], top: int = 20) -> DataFrame:
    """key, score: the boosts of the fields that hold each term, summed; a field counts once a term."""
    score = F.lit(0.0)
    for field, boost in boosts.items():
        low = F.lower(F.coalesce(F.col(field), F.lit("")))
        for t in terms:
            score = score + F.when(low.contains(t), boost).otherwise(0.0)
    return df.select(key, score.alias("score")).groupBy(key).agg(F.max("score").alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(top)


def compare_runs(current: DataFrame, baseline: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, current, baseline, verdict: better, worse, same (within the tolerance), added or gone."""
    c, b = current.select(*keys, F.col(value).alias("current")), baseline.select(*keys, F.col(value).alias("baseline"))
    j = c.join(b, keys, "full")
    gap = F.col("current") - F.col("baseline")
    return j.withColumn("verdict", F.when(F.col("baseline").isNull(), "added").when(F.col("current").isNull(), "gone").when(gap > tolerance, "better").when(gap < -tolerance, "worse").otherwise("same"))


def page_class(chars: Column, scanned_below: int, complex_layout: Column, entropy_high: Column) -> Column:
    """How a page is read: an image of high entropy or of little text is scanned, a complex layout is parsed as such, else the text is taken."""
    return F.when(entropy_high, "scanned").when(chars < scanned_below, "scanned").when(complex_layout, "complex").otherwise("native")


def surface_forms(c: Column, most: int = 8) -> Column:
    """Runs of capitalised words or figures in a question, the longest first, at most ``most``."""
    runs = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?:\b[\p{Lu}\d][\p{L}\d\-]*\s?)+"), F.lit(0)))
    bare = F.filter(F.transform(runs, lambda x: F.trim(x)), lambda x: F.length(x) > 1)
    return F.slice(F.transform(F.array_sort(F.transform(bare, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("t")))), lambda x: x["t"]), 1, most)


def expand_terms(questions: DataFrame, key: str, text: str, glossary: DataFrame) -> DataFrame:
    """key, expanded: a question with the long forms of the short ones it uses. glossary(short, long_form)."""
    w = questions.select(key, text, F.explode_outer(F.array_distinct(F.split(text, r"[^\p{L}\d]+"))).alias("short"))
    g = glossary.groupBy("short").agg(F.min("long_form").alias("long_form"))
    return w.join(g, "short", "left").groupBy(key, text).agg(F.array_sort(F.collect_set("long_form")).alias("x")).select(key, F.concat_ws(" ", text, F.array_join("x", " ")).alias("expanded"))
