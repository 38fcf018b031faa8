"""Mixing sources to target weights.

Method: Sainte-Lague apportionment. A mix's size is cut into equal-token blocks, given to its sources by the highest quotients
share / (2 blocks + 1), a source stopping at what ``max_repeats`` lets it give; a source's blocks go to its shards in the same
way by the shards' tokens; in each shard documents are taken in a seeded order until the shard's blocks are filled, whole
passes first. A shard holds about ``shard_tokens`` tokens however large its source is.

Defined results. Sources are compared in lower case, without outer blanks, hyphens and blanks as underscores; null sources count
for the size of all documents only. A null or empty text has no tokens and is never picked. A source without documents gets no
block, its share goes to the others by their quotients. Of repeated rows of a document one counts. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.session import durable

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The public pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def apportion(weights: list[float], caps: list[int], blocks: int) -> list[int]:
    """Sainte-Lague seats under caps; ties go to the earlier place. A bisection finds all but the last few, a heap those."""
    n = len(weights)
    use = [w > 0 and c > 0 for w, c in zip(weights, caps)]
    blocks = min(blocks, sum(c for c, u in zip(caps, use) if u))

    def seats(x: float) -> list[int]:
        return [min(c, int(w * x + 0.5)) if u else 0 for w, c, u in zip(weights, caps, use)]

    lo, hi = 0.0, 1.0
    while sum(seats(hi)) < blocks:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(seats(mid)) <= blocks - n:
            lo = mid
        else:
            hi = mid
    out = seats(lo) if sum(seats(lo)) <= blocks else [0] * n
    heap = [(-weights[i] / (2 * out[i] + 1), i) for i in range(n) if use[i] and out[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(blocks - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def canonical_source(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"), F.lit(""))


def token_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", ranks_path: str = RANKS) -> DataFrame:
    """key, source (canonical) and tokens of each document, counted with the public tokenizer at ranks_path."""
    kind = docs.schema[key].dataType.simpleString()
    if os.path.exists(ranks_path):
        docs.sparkSession.sparkContext.addFile(ranks_path)  # for executors that do not have it at this place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks_path if os.path.exists(ranks_path) else SparkFiles.get(os.path.basename(ranks_path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=[key, "source", "tokens"])

    rows = docs.where(F.col(key).isNotNull()).select(key, canonical_source(F.col(source)).alias("source"), text)
    counted = rows.mapInArrow(run, f"{key} {kind}, source string, tokens long")
    return counted.groupBy(key).agg(F.max(F.struct("tokens", "source")).alias("r")).select(key, "r.source", "r.tokens")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 1, block_tokens: int = 2048, shard_tokens: int = 4_000_000, ranks_path: str = RANKS) -> DataFrame:
    """One row per mix and document picked: mix_name, key, source, tokens, repeats.

    The quotas come from sums per source and shard: a few rows for every ``shard_tokens`` tokens, the only data the driver sees.
    """
    sizes = durable(token_sizes(docs, key, ranks_path=ranks_path))
    spark = docs.sparkSession
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    wanted = targets.select("mix_name", F.col("total_ratio").cast("double"), canonical_source(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("mix_name is not null and source is not null").distinct().orderBy("mix_name", "source").collect()
    named = spark.createDataFrame([(s,) for s in sorted({r.source for r in wanted})], "source string")  # one row per source of the targets
    per_source = {r.source: r.n for r in sizes.join(F.broadcast(named), "source").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    shards = {s: max(1, -(-n // shard_tokens)) for s, n in per_source.items() if n}
    used = sorted({r.source for r in wanted} & set(shards))
    schema = f"mix_name string, {key} {docs.schema[key].dataType.simpleString()}, source string, tokens long, repeats long"
    if not used:
        return spark.createDataFrame([], schema)
    count = spark.createDataFrame([(s, shards[s]) for s in used], "source string, shards long")  # one row per source of the targets
    placed = sizes.where("tokens > 0").join(F.broadcast(count), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), key), "shards"))
    in_shard = {(r.source, r.shard): r.n for r in placed.groupBy("source", "shard").agg(F.sum("tokens").alias("n")).collect()}
    quotas = []
    for name in sorted({r.mix_name for r in wanted}):
        rows = [r for r in wanted if r.mix_name == name]
        blocks = int((rows[0].total_ratio or 0) * total / block_tokens + 0.5)
        caps = [int((r.max_repeats or 0) * per_source.get(r.source, 0) / block_tokens) for r in rows]
        for r, q in zip(rows, apportion([r.target_share or 0.0 for r in rows], caps, blocks)):
            mine = sorted((k, n) for (s, k), n in in_shard.items() if s == r.source)
            limits = [-(-r.max_repeats * n // block_tokens) for _, n in mine] if mine else []
            for (k, n), b in zip(mine, apportion([float(n) for _, n in mine], limits, q) if mine else []):
                if b:
                    quotas.append((name, r.source, k, n, min(b * block_tokens, r.max_repeats * n)))
    if not quotas:
        return spark.createDataFrame([], schema)
    quota = spark.createDataFrame(quotas, "mix_name string, source string, shard long, shard_tokens long, quota long")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), key), key)
    ranked = placed.withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    rest = F.col("quota") % F.col("shard_tokens")
    repeats = F.expr("quota div shard_tokens") + F.when(F.col("before") + F.col("tokens") / 2 <= rest, 1).otherwise(0)
    # the quota table has a row per mix, source and shard: small beside the documents, joined by key so that it may also be large
    return ranked.join(quota, ["source", "shard"]).select("mix_name", key, "source", "tokens", repeats.cast("long").alias("repeats")).where("repeats > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mix and source of the targets: mix_name, source, target_share, actual_share, mix_tokens, n_docs, most_repeats."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mix_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    want = targets.select("mix_name", canonical_source(F.col("source")).alias("source"), "target_share").distinct()
    all_of_mix = Window.partitionBy("mix_name")  # a row per source
    full = want.join(got, ["mix_name", "source"], "left").withColumn("mix_tokens", F.coalesce("mix_tokens", F.lit(0)))
    return full.select("mix_name", "source", "target_share", F.try_divide("mix_tokens", F.sum("mix_tokens").over(all_of_mix)).alias("actual_share"), "mix_tokens", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
