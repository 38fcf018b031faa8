"""Retrieval: BM25, trigram and vector search, rank fusion, access and trust."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom import policy
from sparkloom.functions import scalars
from sparkloom.operators.graph import expand_groups
from sparkloom.session import durable


def bm25(docs: DataFrame, terms: list[str], key: str, text: str, top: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the top documents for one question's terms; see bm25_many."""
    return bm25_many(docs, {"": terms}, key, text, top, k1, b).drop("q")


def bm25_many(docs: DataFrame, questions: dict[str, list[str]], key: str, text: str, top: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """q, key, score: the top documents of each question. Terms are words in lower case; words are lower-case runs of letters and figures, without stemming or stop words; a term's other signs are matched as they are.

    Whatever the number of questions, the corpus is read twice: once for its figures (documents, mean length, a count for each term), once for the
    scores, of which each task passes on ``top`` rows a question. Nothing is indexed, shuffled or kept. Ties go to the smaller key.
    """
    questions = {q: [t.lower() for t in ts] for q, ts in questions.items()}
    terms = list(dict.fromkeys(t for ts in questions.values() for t in ts if t))
    plain = lambda t: "".join(x if x.isalnum() else "\\" + x for x in t)  # noqa: E731  a term's signs are no pattern
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    inside = r"[\p{L}\p{N}]"
    # a plain search comes before the word count, so texts without a term cost no pattern match
    tf = [F.when(low.contains(t), F.regexp_count(low, F.lit(f"(?<!{inside}){plain(t)}(?!{inside})"))).otherwise(0) for t in terms]
    base = docs.select(F.col(key), F.regexp_count(low, F.lit(f"{inside}+")).alias("_n"), *[c.alias(f"_t{i}") for i, c in enumerate(tf)])
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("mean"), *[F.sum(F.when(F.col(f"_t{i}") > 0, 1).otherwise(0)).alias(f"d{i}") for i in range(len(terms))]).first()
    n, mean = stats["n"] or 0, stats["mean"] or 1.0
    scores = []
    for q, ts in questions.items():
        score = F.lit(0.0)
        for t in filter(None, ts):
            i = terms.index(t)
            df, f = stats[f"d{i}"] or 0, F.col(f"_t{i}")
            score = score + float(np.log(1 + (n - df + 0.5) / (df + 0.5))) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / mean))
        scores.append(F.struct(F.lit(q).alias("q"), F.round(score, 6).alias("score")))
    some = F.greatest(*[F.col(f"_t{i}") for i in range(len(terms))], F.lit(0)) > 0
    hits = base.where(some).select(key, F.explode(F.array(*scores)).alias("s")).select("s.q", key, "s.score").where("score > 0")
    w = Window.partitionBy("q").orderBy(F.desc("score"), key)
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def trigram_search(rows: DataFrame, question: str, key: str, text: str, threshold: float = policy.TRIGRAM_MIN, top: int = 20) -> DataFrame:
    """key, score: share of the question's trigrams a row has."""
    q = scalars.trigrams(F.lit(question))
    share = F.size(F.array_intersect(q, scalars.trigrams(F.col(text)))) / F.size(q)
    return rows.where(F.col(text).isNotNull()).select(key, F.round(share, 6).alias("score")).where(F.col("score") >= threshold).distinct().orderBy(F.desc("score"), key).limit(top)


def vector_search(rows: DataFrame, vector: list[float], key: str, column: str, threshold: float = policy.VECTOR_MIN, top: int = 20) -> DataFrame:
    """key, score by cosine with one vector, exact; nothing for a zero vector."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return rows.select(key, scalars.cosine(F.col(column), q).alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(top)


def exact_topk(rows: DataFrame, queries: DataFrame, key: str, column: str, k: int = 5, block: int = 20_000) -> DataFrame:
    """query_id, key, score, rank: each query's k most similar other rows by exact cosine.

    Queries go out in blocks of at most ``block`` vectors; each meets all rows as matrix products inside the rows' own partitions, which
    pass on k rows a query. Vectors of a length other than the first query's, null or zero match nothing. Ties go to the smaller key.
    """
    dim_row = queries.where(F.size(column) > 0).select(F.size(column)).first()
    kind = rows.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, {key} {kind}, score double"
    spark = rows.sparkSession
    if dim_row is None:
        return spark.createDataFrame([], schema + ", rank long")
    dim = dim_row[0]
    sound = (F.size(column) == dim) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x)) & F.exists(column, lambda x: x != 0)
    mine, theirs = rows.where(sound).select(key, column), queries.where(sound).select(key, column)
    blocks = max(1, -(-theirs.count() // block))
    found = None
    for b in range(blocks):
        t = theirs.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toArrow()
        if not t.num_rows:
            continue
        q = np.asarray(t.column(1).combine_chunks().flatten(), np.float64).reshape(-1, dim)
        shared = spark.sparkContext.broadcast((t.column(0).to_pylist(), q / np.linalg.norm(q, axis=1, keepdims=True)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            places = {i: n for n, i in enumerate(ids)}
            best: list = [[] for _ in ids]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                own = batch.column(0).to_pylist()
                for a in range(0, len(q), 512):
                    s = q[a : a + 512] @ x.T
                    for j, i in enumerate(own):
                        n = places.get(i)
                        if n is not None and a <= n < a + len(s):
                            s[n - a, j] = -2
                    w = min(k, s.shape[1])
                    floor = np.partition(s, -w, axis=1)[:, -w]
                    for n, j in zip(*np.nonzero(s >= floor[:, None])):
                        best[a + n].append((-s[n, j], own[j]))
                for n, v in enumerate(best):
                    if len(v) > 4 * k:
                        best[n] = sorted(v)[:k]
            rows_ = [(ids[n], i, -s) for n, v in enumerate(best) for s, i in sorted(v)[:k] if s < 1.5]
            yield pa.RecordBatch.from_pydict({"query_id": [r[0] for r in rows_], key: [r[1] for r in rows_], "score": pa.array([r[2] for r in rows_], pa.float64())}) if rows_ else pa.RecordBatch.from_pylist([], schema=pa.schema([("query_id", pa.string() if kind == "string" else pa.int64()), (key, pa.string() if kind == "string" else pa.int64()), ("score", pa.float64())]))

        part = mine.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.distinct().withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], key: str, top: int = 20, k: int = policy.RRF_K) -> DataFrame:
    """key, score: the sum of 1 / (k + rank) over ranked lists (key, score); ties go to the better first list, then the key."""
    out = None
    for n, df in enumerate(lists):
        w = Window.orderBy(F.desc("score"), key)  # each list is a top-k
        one = df.select(key, F.row_number().over(w).alias("rank"), F.lit(n).alias("list_no"))
        out = one if out is None else out.unionByName(one)
    fused = out.groupBy(key).agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 10).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    return fused.orderBy(F.desc("score"), "first", key).limit(top).select(key, "score")


def prune(hits: DataFrame, key: str, least: float = policy.PRUNE_MIN) -> DataFrame:
    """Hits of at least ``least``, the best of each key."""
    return hits.where(F.col("score") >= least).groupBy(key).agg(F.max("score").alias("score"))


def keep_order(rows: DataFrame, window, top: int) -> DataFrame:
    """The leading rows of each list in the order they have: what reranking is without a second scorer."""
    return rows.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= top).drop("_r")


def attenuate(score: Column, trust: Column) -> Column:
    """A score damped by low ingestion confidence, by at most 40 %."""
    return score * F.greatest(F.lit(0.6), 1 - 0.5 * (1 - F.coalesce(trust, F.lit(1.0))))


def acl_filter(chunks: DataFrame, user: str, groups: list[str], tenant: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of the tenant whose acl (JSON: users, groups, public) lets the user in, and the ids of those it does not; a malformed acl denies."""
    acl = F.from_json("acl", "struct<users:array<string>,groups:array<string>,public:boolean>")
    may = F.coalesce(acl["public"], F.lit(False)) | F.coalesce(F.array_contains(acl["users"], user), F.lit(False)) | F.coalesce(F.arrays_overlap(acl["groups"], F.array(*[F.lit(g) for g in groups]).cast("array<string>")), F.lit(False))
    allowed = (F.col("tenant_id") == tenant) & may
    return chunks.where(allowed), chunks.where(~F.coalesce(allowed, F.lit(False))).select("chunk_id")


def budgeted(rows: DataFrame, order: str, text: str, budget: int) -> DataFrame:
    """The leading rows whose words times 1.3 stay within the budget; the first is always let in."""
    w = Window.orderBy(order)  # an assembled context: a top-k, never a corpus
    size = F.ceil(scalars.token_count(F.col(text)) * 1.3)
    return rows.withColumn("_used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w)).where((F.col("_used") <= budget) | (F.col("_n") == 1)).drop("_used", "_n")


def retrieve(catalog: DataFrame, key: str, text: str, terms: list[str], question: str, members: DataFrame, trust: str, state: str | None = None, dates: tuple[str, str] | None = None, window: tuple = (None, None), vectors: DataFrame | None = None, vector: list[float] | None = None, top: int = 20) -> DataFrame:
    """key, score: the staged retrieval of a catalogue.

    Rows whose dates miss the window are left out (rows without dates stay); word, trigram and vector search are pruned and fused by rank; the fused files'
    neighbours in their groups, members(node, group), make a further list, fused again; scores are damped by each file's trust, and quarantined files dropped unless
    nothing else is left. Every list is a top-k, so all stages after the searches are small.
    """
    if dates is not None and window != (None, None):
        catalog = catalog.where(scalars.windows_overlap(F.col(dates[0]), F.col(dates[1]), F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")))
    lists = [bm25(catalog, terms, key, text, top), trigram_search(catalog, question, key, text, top=top)]
    if vectors is not None and vector is not None:
        lists.append(vector_search(vectors, vector, key, "embedding", top=top))
    lists = [durable(prune(x, key)) for x in lists]
    seeds = durable(rrf(lists, key, top))
    near = expand_groups(members, seeds.select(key)).select(F.col("node").alias(key), "score")
    fused = rrf([seeds, durable(near)], key, top)
    sure = catalog.select(key, F.col(trust).alias("trust"), (F.col(state) if state else F.lit(None).cast("string")).alias("state")).groupBy(key).agg(F.max("trust").alias("trust"), F.max("state").alias("state"))
    judged = durable(fused.join(sure, key, "left").select(key, F.round(attenuate(F.col("score"), F.col("trust")), 9).alias("score"), "state"))
    bad = F.coalesce(F.upper("state") == "QUARANTINED", F.lit(False))
    clean = judged.where(~bad)
    return (clean if clean.limit(1).count() else judged).select(key, "score").orderBy(F.desc("score"), key)
