"""The k most similar vectors of every vector.

Method: balanced posting lists. Centroids are fitted on a bounded sample (``per_centroid`` rows a centroid, at most
``max_sample``) by a two-level k-means that gives each coarse cell centroids in proportion to its rows. Each vector finds
its nearest centroids by a walk on an in-memory graph of the centroids; it is posted to the nearest and, at a boundary, to
every list whose distance is at most ``1 + ratio`` times the nearest, ``replicas`` lists at most. A vector searches the
lists it is posted to. Inside a list blocks of queries meet all rows of the list.

The number of lists grows with the rows up to ``max_sample / per_centroid``; a list of more than ``split_rows`` rows, be it that
there are more rows than that many lists balance or that a region is crowded, is cut into lists of its own in the same way, so
the work grows with the rows and never with a list's square. Each list puts out one row a vector with its best there. Exact copies
enter the index once and are put back afterwards, so a group of copies of any size costs one row there.

Every row is indexed. Vectors travel as 2 bytes a number, so cosines are right to about 1e-5; ``similar_pairs`` counts those that
near to its bound from the vectors as they are stored. Recall is measured in tests/llm/test_knn.py and in the README.

Defined results. Null, all-zero, non-finite vectors and vectors of another length have no neighbours and are nobody's. Ties in
similarity go to the smaller key. Repeated rows count once. Extra columns are ignored. Fewer than k others: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.session import durable


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """key and vector of the rows that can have a cosine."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("key").isNotNull() & (F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    scale = np.abs(x).max(1, keepdims=True)  # else the norm of very small or large vectors over- or underflows
    x = x / np.where(scale > 0, scale, 1)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).astype(np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; an empty cell is given a row of the largest."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for r in range(rounds + 1):
        label = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        if r == rounds:
            break
        size = np.bincount(label, minlength=k)
        total = np.zeros((k, x.shape[1]))
        np.add.at(total, label, x)
        for j in np.flatnonzero(size == 0):
            total[j] = x[rng.choice(np.flatnonzero(label == size.argmax()))]
        c = unit(total)
    return c, label


class CentroidGraph:
    """Centroids with links to their nearest others; a search walks from the pivots along the links, many queries at once."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray, links: np.ndarray | None = None, degree: int = 16):
        self.c = centroids
        self.pivots = pivots
        if links is not None:
            self.links = links
            return
        n = len(centroids)
        degree = min(degree, n - 1)
        links = np.zeros((n, max(degree, 1)), np.int32)
        for i in range(0, n, 2048):
            s = centroids[i : i + 2048] @ centroids.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            if degree:
                links[i : i + 2048] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
        self.links = links

    def search(self, x: np.ndarray, k: int, beam: int = 8, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids found and their cosines, best first."""
        s = x @ self.c[self.pivots].T
        width = min(beam, s.shape[1])
        top = np.argpartition(-s, width - 1, axis=1)[:, :width]
        ids, sims = self.pivots[top].astype(np.int32), np.take_along_axis(s, top, 1)
        for _ in range(rounds):
            new = self.links[ids].reshape(len(x), -1)
            near = np.matmul(self.c[new], x[:, :, None])[:, :, 0]
            ids, sims = np.concatenate([ids, new], 1), np.concatenate([sims, near], 1)
            order = np.argsort(ids, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -3
            width = min(max(beam, k), ids.shape[1])
            top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def fit_graph(sample: np.ndarray, lists: int, seed: int = 7) -> CentroidGraph:
    """Centroids balanced over the sample: coarse cells first, then in each as many as its share of the rows asks for."""
    rng = np.random.default_rng(seed)
    coarse, label = kmeans(sample, max(1, round(lists**0.5)), 6, rng)
    parts, pivots, at = [], [], 0
    for j in range(len(coarse)):
        own = sample[label == j]
        if not len(own):
            continue
        c, _ = kmeans(own, max(1, round(lists * len(own) / len(sample))), 4, rng)
        parts.append(c)
        near = np.argsort(-(c @ coarse[j]), kind="stable")
        pivots += [at + int(i) for i in dict.fromkeys([near[0], near[-1], near[len(near) // 2]])]
        at += len(c)
    return CentroidGraph(np.concatenate(parts), np.array(pivots, np.int32))


def rows_matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, dim)


def best_of(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of (query, neighbour, cosine), a pair once, ties to the lesser neighbour."""
    order = np.lexsort((b, a))
    a, b, s = a[order], b[order], s[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s = a[once], b[once], s[once]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], s[keep]


def search_list(x: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In one list: places of query and neighbour, and the cosine, for each query's k best (ties by key: rows come sorted by it)."""
    a, b, s = [], [], []
    for i in range(0, len(x), block):
        sim = x[i : i + block] @ x.T
        sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -2
        # the k-th best of some columns bounds the k-th best of all from below
        some = sim[:, : max(2048, k)]
        width = min(k, some.shape[1])
        floor = -np.partition(-some, width - 1, axis=1)[:, width - 1 : width]
        q, n = np.nonzero(sim >= floor)
        exact = np.einsum("ij,ij->i", x[q + i].astype(np.float64), x[n].astype(np.float64))
        keep = (q + i) != n
        q, n, exact = q[keep], n[keep], exact[keep]
        order = np.lexsort((n, -exact, q))
        q, n, exact = q[order], n[order], exact[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        a.append(q[keep] + i)
        b.append(n[keep])
        s.append(exact[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b), np.concatenate(s)) if a else (none, none, none.astype(float))


def posting(graph: CentroidGraph, x: np.ndarray, replicas: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each row's lists."""
    ids, sims = graph.search(x, replicas)
    d = np.sqrt(np.maximum(2 - 2 * sims, 0))
    keep = d <= (1 + ratio) * d[:, :1] + 1e-6
    keep[:, 0] = True
    q, j = np.nonzero(keep)
    return q, ids[q, j]


def search_rows(x: np.ndarray, k: int, split_rows: int, list_rows: int, replicas: int, ratio: float, per_centroid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As search_list; more than split_rows rows are cut into lists first."""
    lists = len(x) // list_rows
    if len(x) <= split_rows or lists < 2:
        return search_list(x, k)
    rng = np.random.default_rng(len(x))
    graph = fit_graph(x[np.sort(rng.choice(len(x), min(len(x), lists * per_centroid), replace=False))], lists)
    parts = [posting(graph, x[i : i + 2048], replicas, ratio) for i in range(0, len(x), 2048)]
    row = np.concatenate([q + 2048 * i for i, (q, _) in enumerate(parts)])
    of = np.concatenate([j for _, j in parts])
    order = np.argsort(of, kind="stable")
    row, of = row[order], of[order]
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
    found = []
    for i, j in zip(cuts[:-1], cuts[1:]):
        mine = row[i:j]
        a, b, s = search_list(x[mine], k)
        found.append((mine[a], mine[b], s))
    return best_of(*(np.concatenate(v) for v in zip(*found)), k)


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, dim: int = 64, list_rows: int = 1000, replicas: int = 6, ratio: float = 0.2, per_centroid: int = 16, max_sample: int = 120_000, split_rows: int = 40_000, small: int = 200_000) -> DataFrame:
    """key_a, key_b, cosine: for every usable vector the k most similar others found. small: the most rows of copies that are broadcast; more are joined by a shuffle."""
    rows = usable(df, key, vector, dim)
    spark = df.sparkSession
    n = df.count()
    lists = max(1, min(n // list_rows, max_sample // per_centroid))
    share = min(1.0, lists * per_centroid / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").toArrow()  # about lists * per_centroid rows, max_sample at most
    sample = unit(rows_matrix(picked.column("v").combine_chunks(), dim)) if picked.num_rows else np.eye(1, dim, dtype=np.float32)
    fitted = fit_graph(sample, lists)
    shared = spark.sparkContext.broadcast((fitted.c, fitted.pivots, fitted.links))  # at most max_sample / per_centroid centroids
    hashed = rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(7), "v"))
    # repeats and exact copies once; whether there are copies goes with the vector
    vectors = hashed.groupBy("h", "g").agg(F.min(F.struct("key", "v")).alias("r"), F.max("key").alias("last")).select("r.key", "r.v", (F.col("last") != F.col("r.key")).alias("more"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph(*shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                x = unit(rows_matrix(batch.column(1), dim))
                q, of = posting(graph, x, replicas, ratio)
                short = np.rint(x * 32767).astype(np.int16)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * dim), len(x), [None, pa.py_buffer(short.tobytes())]).cast(pa.binary())
                row = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(of), batch.column(0).take(row), raw.take(row), batch.column(2).take(row)], names=["list", "key", "x", "more"])

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        keys = t.column("key").combine_chunks()
        x = unit(np.frombuffer(b"".join(t.column("x").to_pylist()), np.int16).reshape(-1, dim))
        a, b, s = search_rows(x, k, split_rows, list_rows, replicas, ratio, per_centroid)
        count = np.bincount(a, minlength=len(x))
        more = t.column("more").combine_chunks()
        cuts, at = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(b)
        lists_ = [pa.ListArray.from_arrays(cuts, v) for v in (pa.array(-s, pa.float32()), keys.take(at), more.take(at))]
        return pa.Table.from_arrays([keys, more, *lists_], names=["key_a", "more", "far", "ids", "copied"])

    kind = df.schema[key].dataType.simpleString()
    posted = vectors.mapInArrow(post, f"list int, key {kind}, x binary, more boolean")
    found = posted.groupBy("list").applyInArrow(search, f"key_a {kind}, more boolean, far array<float>, ids array<{kind}>, copied array<boolean>")
    # a vector's lists are at most ``replicas`` rows of k neighbours; they travel as plain arrays, which take a third of the room of structs
    zipped = F.transform("lists", lambda x: F.transform(x["far"], lambda f, i: F.struct(f.cast("double").alias("far"), x["ids"][i].alias("key"), x["copied"][i].alias("more"))))
    sorted_ = found.groupBy("key_a").agg(F.max("more").alias("more"), F.collect_list(F.struct("far", "ids", "copied")).alias("lists")).select("key_a", "more", F.array_sort(F.flatten(zipped)).alias("near"))
    once = F.filter("near", lambda x, i: (i == 0) | (F.get("near", i - 1)["key"] != x["key"]))  # the same cosine in each list, so one beside the other
    best = durable(sorted_.select("key_a", "more", F.slice(once, 1, k).alias("near")))
    copied = F.col("more") | F.exists("near", lambda x: x["more"])
    plain = best.where(~copied).select("key_a", F.explode("near").alias("x")).select("key_a", F.col("x.key").alias("key_b"), (-F.col("x.far")).alias("cosine"))
    # exact copies: the index holds the smallest key of a group; neighbours are put out as members, and each member gets its group's
    groups = durable(hashed.groupBy("h", "g").agg(F.min("key").alias("rep"), F.max("key").alias("last")).where("rep <> last").select("h", "g", "rep"))
    n_groups = groups.count()
    members = durable(hashed.join(F.broadcast(groups) if n_groups <= small else groups, ["h", "g"]).select("rep", "key").distinct())  # of a counted size, else by a shuffle
    side = F.broadcast if members.count() <= small else (lambda x: x)
    w = Window.partitionBy("rep").orderBy("key")  # cut to k + 1 rows a group before the shuffle
    some = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("key")).alias("copies"))  # k + 1 at most
    pair = lambda far, c: F.struct(far.alias("far"), c.alias("key"))
    own = F.transform(F.coalesce("copies", F.array().cast(f"array<{kind}>")), lambda c: pair(F.lit(-1.0), c))
    with_own = best.where(copied).join(side(some), F.col("key_a") == F.col("rep"), "left").select("key_a", F.concat(F.transform("near", lambda x: pair(x["far"], x["key"])), own).alias("near"))
    each = with_own.select("key_a", F.explode("near").alias("x")).join(side(some.select(F.col("rep").alias("key_b"), "copies")), F.col("x.key") == F.col("key_b"), "left")
    put_out = F.when(F.col("copies").isNull(), F.array("x")).otherwise(F.transform("copies", lambda c: pair(F.col("x.far"), c)))
    of_rep = durable(each.groupBy("key_a").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(put_out)))), 1, k + 1).alias("near")))
    # a large group's members are joined in tiles
    tiles = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / 10_000).cast("int").alias("tiles"))
    rest = members.where("key <> rep").join(side(tiles), "rep").select("rep", "key", F.pmod(F.xxhash64("key"), "tiles").cast("int").alias("tile"))
    lent = of_rep.join(side(tiles), F.col("key_a") == F.col("rep")).select("rep", "near", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    everyone = lent.join(side(rest), ["rep", "tile"]).select(F.col("key").alias("key_a"), "near")
    mine = F.slice(F.filter("near", lambda x: x["key"] != F.col("key_a")), 1, k)
    return plain.unionByName(of_rep.unionByName(everyone).select("key_a", F.explode(mine).alias("x")).select("key_a", F.col("x.key").alias("key_b"), (-F.col("x.far")).alias("cosine")))


def similar_pairs(neighbours: DataFrame, df: DataFrame, key: str, vector: str, min_cosine: float, dim: int = 64, doubt: float = 5e-5, small: int = 200_000) -> DataFrame:
    """key_a, key_b: each unordered pair of neighbours of at least min_cosine once, the smaller key first. Those within ``doubt`` of it are counted from the stored vectors."""
    near = neighbours.where(F.col("cosine") >= min_cosine - doubt).groupBy(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).agg(F.max("cosine").alias("cosine"))
    near = durable(near)
    sure = near.where(F.col("cosine") > min_cosine + doubt).select("key_a", "key_b")
    open_ = near.where(F.col("cosine") <= min_cosine + doubt).select("key_a", "key_b")
    n = open_.count()
    if not n:
        return sure
    side = F.broadcast if n <= small else (lambda x: x)
    keys = open_.select(F.col("key_a").alias("key")).union(open_.select("key_b")).distinct()
    stored = durable(usable(df, key, vector, dim).join(side(keys), "key").groupBy("key").agg(F.min("v").alias("v")))
    both = open_.join(stored.select(F.col("key").alias("key_a"), F.col("v").alias("va")), "key_a").join(stored.select(F.col("key").alias("key_b"), F.col("v").alias("vb")), "key_b")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return sure.unionByName(both.where(dot("va", "vb") / F.sqrt(dot("va", "va")) / F.sqrt(dot("vb", "vb")) >= min_cosine).select("key_a", "key_b"))
