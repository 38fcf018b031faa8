"""Knowledge-graph operators: walks from entities to chunks, quotable evidence, merging of mentions, versions, cascades."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkloom import policy
from sparkloom.operators import graph, search
from sparkloom.session import durable


def walk_to_chunks(edges: DataFrame, mentions: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """seed, chunk, hops: chunks that mention an entity at most ``hops`` steps from a seed; edges(a, b), mentions(entity, chunk), all of one tenant.

    The frontier holds each entity once per seed at its least distance, so walks do not multiply with their paths.
    """
    level = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct().withColumn("entity", F.col("seed")).withColumn("hops", F.lit(0).cast("long"))
    both = graph.undirected(edges, "a", "b").distinct()
    reached = level
    for h in range(hops):
        step = level.join(both, level.entity == both.src).select("seed", F.col("dst").alias("entity"), F.lit(h + 1).cast("long").alias("hops")).distinct()
        level = step.join(reached.select("seed", "entity"), ["seed", "entity"], "left_anti")
        reached = reached.unionByName(level)
    return reached.join(mentions, "entity").groupBy("seed", "chunk").agg(F.min("hops").alias("hops"))


def walk_co_mentions(mentions: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """seed, chunk, hops: chunks at most ``hops`` co-mentions from a seed, over mentions(entity, chunk) alone: a step leads from an entity to all entities of its chunks.

    Entities meet through their chunks, each seed and chunk once, so a crowded chunk costs its entities, not their pairs.
    """
    level = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct().withColumn("entity", F.col("seed"))
    known, reached = level, None
    for h in range(hops + 1):
        chunks = level.join(mentions, "entity").select("seed", "chunk").distinct()
        new = chunks if reached is None else chunks.join(reached.select("seed", "chunk"), ["seed", "chunk"], "left_anti")
        new = durable(new.withColumn("hops", F.lit(h).cast("long")))
        reached = new if reached is None else reached.unionByName(new)
        level = new.join(mentions, "chunk").select("seed", "entity").distinct().join(known, ["seed", "entity"], "left_anti")
        known = known.unionByName(level)
    return reached


def quotable(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """chunk, score: hits(id, score) that are cards are replaced by their source chunks, sources(card, chunk); the best score of a chunk stays."""
    cards = hits.join(sources, hits.id == sources.card).select("chunk", "score")
    plain = hits.join(sources.select(F.col("card").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("chunk"), "score")
    return cards.unionByName(plain).groupBy("chunk").agg(F.max("score").alias("score"))


def multi_vector(legs: dict[str, DataFrame], vector: list[float], key: str, top: int = 20) -> DataFrame:
    """key, score: vector search over several legs (chunks, sections, documents) that name the same keys, fused by rank."""
    lists = [search.vector_search(df, vector, key, "embedding", top=top) for df in legs.values()]
    return search.rrf(lists, key, top)


def merge_unit(keys: list, kinds: list, chunks: list, x: np.ndarray, quantile: float = policy.RESOLUTION_QUANTILE, floor: float = policy.RESOLUTION_FLOOR, bonus: float = policy.SAME_CHUNK_BONUS) -> list:
    """The least key of each mention's cluster: mentions of one type whose cosine (with a bonus in one chunk) reaches the unit's quantile and the floor are one."""
    n = len(keys)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm > 0, norm, 1)
    scored = []
    for i in range(n):
        s = np.clip(u[i] @ u[i + 1 :].T, 0, 1)
        scored += [(float(v) + (bonus if chunks[i] == chunks[i + 1 + j] and chunks[i] is not None else 0.0), i, i + 1 + j) for j, v in enumerate(s) if kinds[i] == kinds[i + 1 + j]]
    band = max(float(np.quantile([s for s, _, _ in scored], quantile)) if scored else 1.0, floor)
    boss = list(range(n))

    def top(i: int) -> int:
        while boss[i] != i:
            boss[i] = boss[boss[i]]
            i = boss[i]
        return i

    for s, i, j in scored:
        if s >= band:
            a, b = top(i), top(j)
            if keys[a] <= keys[b]:
                boss[b] = a
            else:
                boss[a] = b
    return [keys[top(i)] for i in range(n)]


def merge_mentions(df: DataFrame, unit: str, key: str, kind: str, chunk: str, vector: str) -> DataFrame:
    """key, cluster: mentions merged inside each unit (a document). Null vectors and other lengths than the unit's commonest stay alone."""
    types = dict(df.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key).drop_duplicates(key)
        sizes = g[vector].map(lambda v: -1 if v is None else len(v))
        common = sizes[sizes > 0].mode()
        good = sizes == (common.iloc[0] if len(common) else -2)
        part = g[good.to_numpy()]
        out = dict(zip(g[key], g[key]))
        if len(part):
            out |= dict(zip(part[key], merge_unit(part[key].tolist(), part[kind].tolist(), part[chunk].tolist(), np.stack(part[vector].to_numpy()).astype(np.float64))))
        return pd.DataFrame({key: list(out), "cluster": list(out.values())})

    return df.select(F.col(unit).alias("_unit"), key, F.col(kind).alias(kind if kind != unit else "_kind"), chunk, vector).where(F.col(key).isNotNull()).groupBy("_unit").applyInPandas(run, f"{key} {types[key]}, cluster {types[key]}")


def next_version(known: DataFrame, terms: DataFrame) -> DataFrame:
    """tenant, version, signature: a tenant's terms(tenant, term) get the version after known(tenant, version, signature) unless their order-free signature is the latest one's."""
    new = terms.groupBy("tenant").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("term")))), "|"), 256).alias("new"))
    last = known.groupBy("tenant").agg(F.max(F.struct("version", "signature")).alias("l"))
    return new.join(last, "tenant", "left").select("tenant", F.when(F.col("l.signature") == F.col("new"), F.col("l.version")).otherwise(F.coalesce(F.col("l.version"), F.lit(0)) + 1).alias("version"), F.col("new").alias("signature"))


def delete_documents(deleted: DataFrame, chunks: DataFrame, mentions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of chunks(doc_id, chunk), mentions(entity, chunk) and edges(a, b) when documents go: entities without a mention go, with their edges."""
    gone = deleted.select(F.col(deleted.columns[0]).alias("doc_id")).distinct()
    kept_chunks = chunks.join(gone, "doc_id", "left_anti")
    kept_mentions = mentions.join(kept_chunks.select("chunk").distinct(), "chunk", "left_semi")
    alive = kept_mentions.select("entity").distinct()
    ends = [alive.select(F.col("entity").alias(c)) for c in ("a", "b")]
    kept_edges = reduce(lambda e, k: e.join(k, k.columns[0], "left_semi"), ends, edges)
    return kept_chunks, kept_mentions, kept_edges.select("a", "b")
