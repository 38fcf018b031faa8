"""Graph operators over edge tables: components, PageRank, bounded paths, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.session import durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node): alternating large-star and small-star steps, which halve the longest chains.

    Each step is a map-side combined minimum and a join, so the centre of a hub is no hot task; AQE splits its join rows.
    Null ends are left out; a loop edge makes a component of one node.
    """
    kept = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    pairs = durable(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    pairs = pairs.where("u <> v")
    while True:  # until at rest
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        new = durable(small.where("u <> v"))
        # at rest each node has one edge, to its component's least node, which itself has none
        ups = new.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        heads = new.select(F.col("v").alias("u")).distinct()
        moving = ups.where("n > 1").limit(1).count() or heads.join(ups, "u", "left_semi").limit(1).count()
        pairs = new
        if not moving:
            break
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def undirected(edges: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """Each edge in both directions as src, dst."""
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), *keep).unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"), *keep))


def pagerank(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight", damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """node, rank of a weighted undirected graph; ranks sum to 1. Checkpointed every fifth round."""
    e = undirected(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b, F.col(weight).cast("double").alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    share = durable(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = share.select(F.col("src").alias("node")).distinct()
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for r in range(rounds):
        moved = share.join(ranks, share.src == ranks.node).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        ranks = nodes.join(moved, nodes.node == moved.dst, "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if r % 5 == 4:
            ranks = durable(ranks)
    return ranks


def bounded_paths(edges: DataFrame, starts: DataFrame, max_hops: int = 4, a: str = "a", b: str = "b", confidence: str = "confidence", per_pair: int = 8) -> DataFrame:
    """start, end, hops, path, confidence (the least along the path): simple paths of at most max_hops from the starts, the per_pair best for each end.

    Paths come in order of hops, so an end that has per_pair shorter ones takes no longer; a path still leads on from such an end. A level's
    paths to one end are numbered after a partial limit in each task, so a hub's paths are no unbounded group.
    """
    e = undirected(edges, a, b, F.col(confidence).alias("c"))
    level = starts.select(F.col(starts.columns[0]).alias("start")).distinct().select("start", F.col("start").alias("end"), F.array("start").alias("path"), F.lit(None).cast("double").alias("confidence"))
    w = Window.partitionBy("start", "end").orderBy(F.desc("confidence"), F.array_join("path", ">"))
    found = None
    for hop in range(1, max_hops + 1):
        step = level.join(e, level.end == e.src).where(~F.array_contains("path", F.col("dst")))
        level = step.select("start", F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path"), F.least(F.col("confidence"), F.col("c")).alias("confidence"))
        best = level.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_pair).withColumn("hops", F.lit(hop).cast("long"))
        found = best if found is None else found.unionByName(best)
    last = Window.partitionBy("start", "end").orderBy("hops", "r")
    return found.withColumn("n", F.row_number().over(last)).where(F.col("n") <= per_pair).select("start", "end", "hops", F.array_join("path", ">").alias("path"), "confidence")


def neighbours(edges: DataFrame, seeds: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes next to a seed that are no seeds themselves."""
    s = seeds.select(F.col(seeds.columns[0]).alias("src")).distinct()
    return undirected(edges, a, b).join(s, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(s.select(F.col("src").alias("node")), "node", "left_anti")


def expand_one_hop(edges: DataFrame, seeds: DataFrame, a: str = "a", b: str = "b", confidence: str = "confidence", min_confidence: float = 0.72, per_seed: int = 10, hub_degree: int = 15, hub_factor: float = 0.8) -> DataFrame:
    """node, score: neighbours of the seeds over edges of at least min_confidence, per_seed best a seed, hubs damped, the best score of a node kept."""
    e = undirected(edges.where(F.col(confidence) >= min_confidence), a, b, F.col(confidence).alias("c"))
    s = seeds.select(F.col(seeds.columns[0]).alias("src")).distinct()
    degree = e.groupBy("src").agg(F.count_distinct("dst").alias("degree")).select(F.col("src").alias("dst"), "degree")
    near = e.join(s, "src", "left_semi").join(s.select(F.col("src").alias("dst")), "dst", "left_anti").join(degree, "dst", "left")
    scored = near.withColumn("score", F.col("c") * F.when(F.col("degree") > hub_degree, hub_factor).otherwise(1.0))
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_seed).groupBy(F.col("dst").alias("node")).agg(F.max("score").alias("score"))


def bridges(edges: DataFrame, shortlist: DataFrame, a: str = "a", b: str = "b", confidence: str = "confidence") -> DataFrame:
    """External nodes next to at least two shortlisted ones: node, n_linked, min_confidence."""
    s = shortlist.select(F.col(shortlist.columns[0]).alias("src")).distinct()
    e = undirected(edges, a, b, F.col(confidence).alias("c")).join(s, "src", "left_semi").join(s.select(F.col("src").alias("dst")), "dst", "left_anti")
    return e.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("n_linked"), F.min("c").alias("min_confidence")).where("n_linked >= 2")


def expand_groups(members: DataFrame, seeds: DataFrame, confidence: float = 0.9, per_seed: int = 10, hub_degree: int = 15, hub_factor: float = 0.8) -> DataFrame:
    """node, score: as expand_one_hop where all members(node, group) of a group are linked with each other: seeds meet the members of their groups, without a row for each pair of members.

    A group's members are cut to the first per_seed + 1 before they meet a seed, as all of them score the same for it.
    """
    s = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    sizes = members.groupBy("group").agg(F.count_distinct("node").alias("n"))
    score = confidence * F.when(F.col("n") - 1 > hub_degree, hub_factor).otherwise(1.0)
    others = members.join(s.select(F.col("seed").alias("node")), "node", "left_anti").distinct()
    w = Window.partitionBy("group").orderBy("node")
    first = others.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_seed).join(sizes, "group").select("group", "node", score.alias("score"))
    near = members.select(F.col("node").alias("seed"), "group").distinct().join(s, "seed", "left_semi").join(first, "group").groupBy("seed", "node").agg(F.max("score").alias("score"))
    best = Window.partitionBy("seed").orderBy(F.desc("score"), "node")
    return near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_seed).groupBy("node").agg(F.max("score").alias("score"))
