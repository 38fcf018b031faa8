"""Document operators: chunks, sections, glossary terms, links, coverage, dedup, communities."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom import policy
from sparkloom.functions import scalars
from sparkloom.operators.graph import connected_components
from sparkloom.session import durable

SENTENCE = re.compile(r"(?<=[.!?])\s+")


def pack_sentences(text: str | None, size: int = policy.CHUNK_TOKENS, overlap: int = policy.CHUNK_OVERLAP) -> list[str]:
    """Whole sentences packed greedily to ``size`` words; each next chunk begins with the last sentences of the one before, up to ``overlap`` words."""
    parts = [(s, len(s.split())) for s in SENTENCE.split((text or "").strip()) if s]
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for part in parts:
        if held and sum(n for _, n in held) + part[1] > size:
            out.append(" ".join(s for s, _ in held))
            room, keep = overlap, []
            for s, n in reversed(held):
                if n > room:
                    break
                room -= n
                keep.append((s, n))
            held = keep[::-1]
        held.append(part)
    return [*out, " ".join(s for s, _ in held)] if held else out


def chunk_text(docs: DataFrame, key: str, text: str, size: int = policy.CHUNK_TOKENS, overlap: int = policy.CHUNK_OVERLAP) -> DataFrame:
    """key, chunk_no, chunk_text, n_tokens; a null or blank text has none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(k, i, c, len(c.split())) for k, t in df.itertuples(index=False) for i, c in enumerate(pack_sentences(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk_text", "n_tokens"])

    return docs.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {kind}, chunk_no long, chunk_text string, n_tokens long")


def table_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_no, chunk_text: each row of a markdown table under the table's header."""
    rows = scalars.table_rows(F.col(text))
    return df.select(key, rows.alias("r")).where(F.size("r") > 1).select(key, F.col("r")[0].alias("head"), F.posexplode(F.slice("r", 2, 1_000_000_000)).alias("chunk_no", "row")).select(key, F.col("chunk_no").cast("long").alias("chunk_no"), F.concat_ws("\n", "head", "row").alias("chunk_text"))


def is_heading(text: Column, kind: Column | None = None) -> Column:
    body = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.size(F.split(body, " "))
    ok = (body != "") & (words <= policy.HEADING_WORDS) & (F.length(body) <= policy.HEADING_CHARS)
    return F.coalesce(ok if kind is None else ok & (kind == "text"), F.lit(False))


def sectionize(chunks: DataFrame, doc: str, order: str, text: str, page: str | None = None, kind: str | None = None) -> DataFrame:
    """doc, section_no, n_chunks, first, last (order), fingerprint: a section opens at each heading; a document without headings goes by page."""
    w = Window.partitionBy(doc).orderBy(order)
    head = chunks.withColumn("_h", is_heading(F.col(text), F.col(kind) if kind else None).cast("int"))
    any_head = F.max("_h").over(Window.partitionBy(doc)) > 0
    first = F.row_number().over(w) == 1
    opens = F.when(any_head, F.when(first, 1).otherwise(F.col("_h"))).otherwise(F.when(first, 1).otherwise((F.col(page) != F.lag(page).over(w)).cast("int") if page else F.lit(0)))
    numbered = head.withColumn("_o", opens).withColumn("section_no", (F.sum("_o").over(w) - 1).cast("long"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: F.trim(F.regexp_replace(x["t"], r"\s+", " "))), "\n")
    return numbered.groupBy(doc, "section_no").agg(F.count(F.lit(1)).alias("n_chunks"), F.min(order).alias("first"), F.max(order).alias("last"), F.substring(F.sha2(body, 256), 1, 16).alias("fingerprint"))


def content_dedup(docs: DataFrame, key: str, text: str, tenant: str) -> DataFrame:
    """key, keep_key, n_copies: exact copies of a text within a tenant; the least key is kept. Blanks are collapsed before hashing."""
    h = docs.where(F.col(text).isNotNull()).select(key, tenant, F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256).alias("h"))
    g = h.groupBy(tenant, "h").agg(F.min(key).alias("keep_key"), F.count_distinct(key).alias("n_copies"))
    return h.join(g, [tenant, "h"]).select(key, "keep_key", "n_copies").distinct()


def value_links(sections: DataFrame, key: str, text: str) -> DataFrame:
    """key_a, key_b, n_shared: sections that share a code (letters, hyphen, figures) which at least two and at most eight sections hold; so a code's pairs are bounded."""
    code = sections.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,}-\d+\b"), F.lit(0)))).alias("code")).distinct()
    few = code.join(code.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(policy.LINK_MIN, policy.LINK_MAX)), "code", "left_semi")
    other = few.select("code", F.col("k").alias("key_b"))
    return few.select("code", F.col("k").alias("key_a")).join(other, "code").where("key_a < key_b").groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("n_shared"))


def glossary_lift(docs: DataFrame, text: str, background: DataFrame, least: float = policy.GLOSSARY_LIFT, oov: float = policy.GLOSSARY_OOV) -> DataFrame:
    """term, n, lift: words whose log10 rate in docs is at least ``least`` above that in the background(term, log_rate)."""
    words = F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: F.length(x) >= 3))
    counts = docs.select(words.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    j = counts.join(background, "term", "left").join(F.broadcast(total))  # one row
    lift = F.log10("n") - F.log10("total") - F.coalesce("log_rate", F.lit(oov))
    return j.select("term", "n", F.round(lift, 4).alias("lift")).where(F.col("lift") >= least)


def definitions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, short, long_form: ``Long Form (LF)``, ``LF (Long Form)`` and ``LF stands for Long Form``, the long form cut to the words the initials ask for."""
    a = F.regexp_extract_all(text, F.lit(r"((?:[A-Z][\w-]*\s+){1,7}[A-Z][\w-]*)\s+\(([A-Z]{2,8})\)"), F.lit(1))
    b = F.regexp_extract_all(text, F.lit(r"((?:[A-Z][\w-]*\s+){1,7}[A-Z][\w-]*)\s+\(([A-Z]{2,8})\)"), F.lit(2))
    c = F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,8})\s+(?:\(|stands\s+for\s+)((?:[A-Z][\w-]*\s+){1,7}[A-Z][\w-]*)"), F.lit(1))
    e = F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,8})\s+(?:\(|stands\s+for\s+)((?:[A-Z][\w-]*\s+){1,7}[A-Z][\w-]*)"), F.lit(2))
    pairs = F.concat(F.zip_with(b, a, lambda s, l: F.struct(s.alias("short"), l.alias("l"))), F.zip_with(c, e, lambda s, l: F.struct(s.alias("short"), l.alias("l"))))
    words = F.split("l", r"\s+")
    cut = F.slice(words, F.greatest(F.lit(1), F.size(words) - F.length("short") + 1), F.length("short"))
    return docs.select(key, F.explode(pairs).alias("p")).select(key, "p.*").withColumn("w", cut).where(F.upper(F.array_join(F.transform("w", lambda x: F.substring(x, 1, 1)), "")) == F.col("short")).select(key, "short", F.array_join("w", " ").alias("long_form")).distinct()


def reconcile_terms(found: DataFrame, date: str | None = None) -> DataFrame:
    """short, status, long_form: STATED with one expansion, CONFLICTING with several (the latest, else the least, is shown)."""
    pick = F.max_by("long_form", date) if date else F.min("long_form")
    return found.groupBy("short").agg(F.when(F.count_distinct(F.lower("long_form")) > 1, "CONFLICTING").otherwise("STATED").alias("status"), pick.alias("long_form"))


def coverage(mentions: DataFrame, subject: str, date: str) -> DataFrame:
    """subject, first_date, last_date, n_mentions, per_day."""
    g = mentions.where(F.col(date).isNotNull() & F.col(subject).isNotNull()).groupBy(subject).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n_mentions"))
    return g.withColumn("per_day", F.round(F.col("n_mentions") / (F.datediff("last_date", "first_date") + 1), 6))


def grounded(span: Column, text: Column) -> Column:
    """Whether a span stands in a text: anywhere without regard to case, or, up to three characters long, as a whole word."""
    short = F.length(span) <= 3
    word = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.when(short, F.concat(F.lit(" "), word, F.lit(" ")).contains(F.concat(F.lit(" "), F.lower(span), F.lit(" ")))).otherwise(F.lower(text).contains(F.lower(span)))


def _conflicting(key_type: pa.DataType):
    """The pairs between one block of asserting and one of negating chunks that share two words or more, counted by a product of their word tables."""

    def run(block: pa.Table) -> pa.Table:
        neg = block["neg"].to_numpy(zero_copy_only=False).astype(bool)
        words = block["words"].combine_chunks()
        ids = words.flatten().dictionary_encode().indices.to_numpy()
        row = np.repeat(np.arange(len(neg)), words.value_lengths().to_numpy(zero_copy_only=False))
        keys = block["k"].combine_chunks().dictionary_encode()
        code, place, which = keys.indices.to_numpy(), np.zeros(len(neg), np.int64), []
        for side in (~neg, neg):  # rows of one key are one chunk
            distinct, place[side] = np.unique(code[side], return_inverse=True)
            which.append(distinct)
        shared = np.zeros((len(which[0]), len(which[1])), np.float32)
        for first in range(0, ids.max(initial=-1) + 1, 4096):  # whole numbers below 2^24, so exact
            side = [np.zeros((n, 4096), np.float32) for n in shared.shape]
            here = (ids >= first) & (ids < first + 4096)
            for k in (0, 1):
                take = here & (neg[row] == bool(k))
                side[k][place[row[take]], ids[take] - first] = 1
            shared += side[0] @ side[1].T
        i, j = np.nonzero(shared >= 2)
        ka, kb = (keys.dictionary.take(pa.array(which[k][x])).cast(key_type) for k, x in ((0, i), (1, j)))
        return pa.table({"ka": ka, "kb": kb, "n_shared": pa.array(shared[i, j].astype(np.int64))})

    return run


def conflicts(chunks: DataFrame, key: str, text: str, topic: str, block_rows: int = 1000) -> DataFrame:
    """key_a, key_b, n_shared: chunks of one topic that share two content words or more, one with a negation, the other without.

    Every pair is given, however frequent its words: chunks of a topic meet in blocks of about block_rows of each side, so no task
    holds a topic. Content words have three characters or more and are no stop words. Null topics and keys have no pair; rows of one key, topic and sign count as one chunk.
    """
    negated = F.lower(text).rlike(r"\b(?:not|no|never|none|without|cannot|neither|nor)\b")
    content = F.filter(scalars.tokens(F.col("text"), 3), lambda x: ~x.isin(*policy.CONFLICT_STOP))
    rows = chunks.select(F.col(topic).alias("topic"), F.col(key).alias("k"), negated.alias("neg"), F.col(text).alias("text")).where("topic is not null and k is not null and neg is not null")
    per = rows.groupBy("topic").agg(*[F.ceil(F.count_if(F.col("neg") == F.lit(x)) / block_rows).cast("int").alias(n) for x, n in ((False, "n_for"), (True, "n_against"))]).where("n_for > 0 and n_against > 0")
    # each chunk goes to its own block of its side, beside every block of the other
    own = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    every = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    at = lambda f, g: F.struct(f.alias("f"), g.alias("g"))
    cells = F.when(F.col("neg"), every("n_for", lambda x: at(x, own("n_against")))).otherwise(every("n_against", lambda x: at(own("n_for"), x)))
    sides = rows.join(per, "topic").select("topic", "k", "neg", content.alias("words"), F.explode(cells).alias("at")).select("topic", "k", "neg", "words", "at.f", "at.g")
    kind = rows.schema["k"].dataType
    found = sides.groupBy("topic", "f", "g").applyInArrow(_conflicting(to_arrow_type(kind)), f"ka {kind.simpleString()}, kb {kind.simpleString()}, n_shared long")
    return found.where("ka <> kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "n_shared")


def greedy_modularity(edges: list[tuple[str, str, float]]) -> dict[str, int]:
    """Communities by merging, best gain in modularity first, until no merge gains; ties by the least nodes."""
    weight: dict[str, dict[str, float]] = {}
    for a, b, w in edges:
        if a != b:
            weight.setdefault(a, {})[b] = weight.setdefault(a, {}).get(b, 0.0) + w
            weight.setdefault(b, {})[a] = weight.setdefault(b, {}).get(a, 0.0) + w
    total = sum(sum(x.values()) for x in weight.values())
    members = {n: [n] for n in weight}
    degree = {n: sum(x.values()) / total for n, x in weight.items()} if total else {}
    link = {a: {b: w / total for b, w in x.items()} for a, x in weight.items()}
    gain = lambda a, b: 2 * (link[a][b] - degree[a] * degree[b])
    heap = [(-gain(a, b), a, b) for a in link for b in link[a] if a < b]
    heapq.heapify(heap)
    while heap:
        g, a, b = heapq.heappop(heap)
        if a not in link or b not in link.get(a, {}) or abs(-g - gain(a, b)) > 1e-12:
            continue
        if -g <= 1e-12:
            break
        for c, w in link.pop(b).items():
            link[c].pop(b)
            if c != a:
                link[a][c] = link[a].get(c, 0.0) + w
                link[c][a] = link[a][c]
        degree[a] += degree.pop(b)
        members[a] += members.pop(b)
        for c in link[a]:
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (-gain(x, y), x, y))
    order = sorted(members.values(), key=lambda m: (-len(m), min(m)))
    return {n: i for i, m in enumerate(order) for n in m}


def communities(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight", min_size: int = policy.COMMUNITY_MIN, max_edges: int = 200_000) -> DataFrame:
    """node, community (its least node), size: greedy modularity inside each connected component.

    A component over max_edges edges is never put into one task: its communities come from ten rounds of weighted label passing over joins.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).cast("string").alias("a"), F.greatest(a, b).cast("string").alias("b"), F.col(weight).cast("double").alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    comp = connected_components(e).select(F.col("node").alias("a"), "component")
    placed = e.join(comp, "a")
    large = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_edges).select("component")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        label = greedy_modularity(list(df[["a", "b", "w"]].itertuples(index=False)))
        least: dict[int, str] = {}
        for n, c in label.items():
            least[c] = min(n, least.get(c, n))
        return pd.DataFrame([(n, least[c]) for n, c in label.items()], columns=["node", "community"])

    found = placed.join(large, "component", "left_anti").groupBy("component").applyInPandas(run, "node string, community string")
    if large.limit(1).count():
        big = placed.join(large, "component", "left_semi")
        both = big.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(big.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
        label = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
        for _ in range(10):
            votes = both.join(label, both.src == label.node).groupBy("dst", "community").agg(F.sum("w").alias("v"))
            label = durable(votes.groupBy(F.col("dst").alias("node")).agg(F.max(F.struct("v", "community")).alias("m")).select("node", F.col("m.community").alias("community")))
        found = found.unionByName(label)
    size = found.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return found.join(size, "community").select("node", "community", "size")


def cards(sections: DataFrame, key: str, text: str, tags: str) -> DataFrame:
    """key, card: the beginning of a section's text (480 characters) and its first tags."""
    return sections.select(key, F.concat_ws(" | ", F.substring(F.regexp_replace(text, r"\s+", " "), 1, policy.CARD_CHARS), F.array_join(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 5), ", ")).alias("card"))
