"""Parent-child rows to full hierarchies.

Method: label connected components, co-locate each component, walk it depth first with node colouring, put out paths,
descendants and back-edge cycles. What a walk puts out is known beforehand: the sum of its nodes' depths. Components are
hashed into buckets by that volume; one whose volume alone is over ``max_volume`` is never put into one task: its paths come
from pointer doubling over joins, with every column the same as from the walk.

Defined results. The newest row of an id counts (latest ``updated_at``, ties by the greatest remaining columns); a null id is
left out; ids and parent ids are compared after ``canonical_id``. A node without a parent, or whose parent is no node, is a
root of depth 0. A node whose chain of parents enters a loop has depth -1, root = the smallest id on the loop, no path, no
ancestors and -1 descendants. An empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.session import durable

SCHEMA = "key string, root_key string, depth long, ancestors array<string>, names array<string>, n_below long, on_loop boolean"
BLANKS = r"[\s\p{Z}\u200b\ufeff]+"  # tabs, line ends and no-break blanks too


def canonical_id(c: Column) -> Column:
    """An id in lower case, without white space of any kind around it, braces and urn prefix, with the hyphens of a 32-digit form put back."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), f"^{BLANKS}|{BLANKS}$", ""), r"^(urn:uuid:|\{)|\}$", "")
    plain = F.regexp_replace(plain, r"^urn:uuid:", "")
    return F.regexp_replace(plain, r"^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", r"$1-$2-$3-$4-$5")


def newest_nodes(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", name_col: str = "name", order_col: str = "updated_at") -> DataFrame:
    """One row per node: key, id, name, parent_key (null for a root). Aggregated map-side, so repeats of one id are no hot group."""
    nodes = (
        rows.where(F.col(id_col).isNotNull())
        .select(canonical_id(F.col(id_col)).alias("key"), F.struct(F.col(order_col).alias("at"), F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(name_col).alias("name")).alias("row"))
        .groupBy("key").agg(F.max("row").alias("row"))
        .select("key", F.col("row.id").alias("id"), F.col("row.name").alias("name"), canonical_id(F.col("row.parent")).alias("parent"))
    )
    known = nodes.select(F.col("key").alias("parent"), F.lit(True).alias("known"))
    return nodes.join(known, "parent", "left").select("key", "id", "name", F.when(F.col("known"), F.col("parent")).alias("parent_key"))


def _packed(df: DataFrame) -> DataFrame:
    """df in no more partitions than a shuffle makes: a union adds those of its sides, and a loop of unions would double them each round."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def label_components(nodes: DataFrame) -> DataFrame:
    """nodes with ``component``: the root's key, or the smallest key on the loop the chain of parents enters; ``looped``; and ``steps`` up to the root (-1 where looped).

    Pointer doubling: after round r a node knows the node 2^r steps up and the smallest key on the way. The rounds end
    when one resolves no further node: distances to a root are gapless along a chain, so no longer chain is left then.
    What is unresolved then hangs on a loop; for it the doubling goes on until the label stands still.
    """
    one = F.when(F.col("parent_key").isNull(), 0).otherwise(1).cast("long")
    state = durable(nodes.select("key", F.col("parent_key").alias("up"), F.coalesce("parent_key", "key").alias("top"), F.coalesce("parent_key", "key").alias("low"), one.alias("steps")))
    left, first = state.where("up is not null").count(), True
    while left:
        there = state.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("low").alias("low2"), F.col("steps").alias("steps2"))
        go = state.where("up is not null").join(there, "up", "left")
        moved = go.select("key", F.col("up2").alias("up"), F.col("top2").alias("top"), F.least("low", "low2").alias("low"), (F.col("steps") + F.col("steps2")).alias("steps"))
        state = durable(_packed(state.where("up is null").select("key", "up", "top", "low", "steps").unionByName(moved)))
        now = state.where("up is not null").count()
        if now == left and not first:
            break
        left, first = now, False
    rest = state.where("up is not null").select("key", "up", "low")
    while left:
        # label: the least key on the 2^r steps that follow the node 2^r steps up. Those stretches cover a loop without gaps,
        # so once each node's label is that of the node 2^r steps up, it is the loop's least key.
        there = rest.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        step = rest.join(there, "up").select("key", "low", "low2", F.col("up2").alias("up"))
        rest = durable(step.select("key", "up", F.least("low", "low2").alias("low"), F.col("low2").alias("label")))
        check = rest.select(F.col("key").alias("up"), F.col("label").alias("label2"))
        if not rest.join(check, "up").where("label <> label2").limit(1).count():
            break
    ended = state.where("up is null").select("key", F.col("top").alias("component"), F.lit(False).alias("looped"), "steps")
    if left:
        ended = ended.unionByName(rest.select("key", F.col("label").alias("component"), F.lit(True).alias("looped"), F.lit(-1).cast("long").alias("steps")))
    return nodes.join(ended, "key")


def walk_component(keys: list[str], parents: list[str | None], names: list[str | None], paths: bool = True) -> list[tuple]:
    """Depth-first walk with colours over one or more whole components; a step onto a grey node closes a loop. Without paths a node costs the same however deep it lies."""
    name = dict(zip(keys, names))
    up = {k: p for k, p in zip(keys, parents) if p is not None}
    below: dict[str, list[str]] = {}
    for k, p in up.items():
        below.setdefault(p, []).append(k)
    out: list[tuple] = []
    black: set[str] = set()
    for root in sorted(k for k in keys if k not in up):
        pre, path, path_names = 0, [], []
        stack: list[tuple[str, bool]] = [(root, False)]
        entered: dict[str, int] = {}
        while stack:
            k, leave = stack.pop()
            if leave:
                out.append((k, root, len(path) - 1, path[:-1] if paths else [], list(path_names) if paths else [], pre - entered[k] - 1, False))
                path.pop()
                path_names.pop()
                black.add(k)
                continue
            entered[k] = pre
            pre += 1
            path.append(k)
            path_names.append(name[k])
            stack.append((k, True))
            stack.extend((x, False) for x in sorted(below.get(k, ()), reverse=True))
    least: dict[str, str] = {}
    loops: set[str] = set()
    for start in keys:
        if start in black or start in least:
            continue
        grey: dict[str, int] = {}
        k = start
        while k not in grey and k not in least:
            grey[k] = len(grey)
            k = up[k]
        if k in least:
            label = least[k]
        else:  # a back edge
            loop = [x for x, i in grey.items() if i >= grey[k]]
            label = min(loop)
            loops.update(loop)
        for x in grey:
            least[x] = label
    out += [(k, label, -1, [], [], -1, k in loops) for k, label in least.items()]
    return out


def _walk_buckets(paths: bool):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = walk_component(batch["key"].tolist(), [p if isinstance(p, str) else None for p in batch["parent_key"]], batch["name"].tolist(), paths)
        return pd.DataFrame(rows, columns=["key", "root_key", "depth", "ancestors", "names", "n_below", "on_loop"])

    return run


def _on_loops(looped: DataFrame) -> DataFrame:
    """key, on_loop (true): the nodes on a loop, from those whose chain of parents enters one.

    The nodes some node has 2^r steps above it: the loop's always, and those off it with a chain that long below them.
    Their number falls until only the loops are left; with parents within the set they then are as many as their parents.
    """
    up = looped.select("key", F.col("parent_key").alias("up"))
    state = durable(up)
    left = state.count()
    while left:
        # the images of the step doubled so far, and the step itself among them
        images = state.select(F.col("up").alias("key")).distinct()
        kept = state.join(images, "key", "left_semi")
        there = state.select(F.col("key").alias("up"), F.col("up").alias("up2"))
        state = durable(kept.join(there, "up").select("key", F.col("up2").alias("up")))
        now = state.count()
        if now == left:
            break
        left = now
    return state.select("key", F.lit(True).alias("on_loop"))


def _double_paths(nodes: DataFrame, paths: bool = True) -> DataFrame:
    """The columns of the walk for components too large for one task, by pointer doubling over joins (no group is gathered)."""
    none = F.array().cast("array<string>")
    up = F.when(~F.col("looped"), F.col("parent_key"))
    first = F.array("parent_key") if paths else none
    state = nodes.select("key", "component", "looped", "steps", up.alias("up"), F.when(up.isNull(), none).otherwise(first).alias("ancestors"), (F.array("name") if paths else none).alias("names"), F.lit(1).cast("long").alias("below"))
    if paths:
        state = durable(state)
        while state.where("up is not null").limit(1).count():
            there = state.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("ancestors").alias("a2"), F.col("names").alias("n2"))
            moved = state.where("up is not null").join(there, "up").select("key", "component", "looped", "steps", F.col("up2").alias("up"), F.concat("a2", "ancestors").alias("ancestors"), F.concat("n2", "names").alias("names"), "below")
            state = durable(_packed(state.where("up is null").unionByName(moved)))
    on = _on_loops(nodes.where("looped"))
    below = _below(nodes.where("not looped"))
    return state.join(below, "key", "left").join(on, "key", "left").select(
        "key", F.col("component").alias("root_key"), F.col("steps").alias("depth"), F.when(F.col("looped"), none).otherwise(F.col("ancestors")).alias("ancestors"), F.when(F.col("looped") | F.lit(not paths), none).otherwise(F.col("names")).alias("names"),
        F.when(F.col("looped"), F.lit(-1)).otherwise(F.coalesce("n_below", F.lit(0))).cast("long").alias("n_below"), F.coalesce("on_loop", F.lit(False)).alias("on_loop"),
    )


def _below(nodes: DataFrame) -> DataFrame:
    """key, n_below of tree nodes, in as many rounds as the depth has binary digits and rows as there are nodes: after round r a
    node has counted those less than 2^r steps below it; those 2^r and more below reach it through the nodes 2^r steps below."""
    state = durable(nodes.select("key", F.col("parent_key").alias("up"), F.lit(1).cast("long").alias("seen")))
    while state.where("up is not null").limit(1).count():
        # the counts of the nodes 2^r steps below, summed before they meet the node
        come = state.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("seen").alias("more"))
        there = state.select(F.col("key").alias("up"), F.col("up").alias("up2"))
        state = durable(_packed(state.join(there, "up", "left").join(come, "key", "left").select("key", F.col("up2").alias("up"), (F.col("seen") + F.coalesce("more", F.lit(0))).alias("seen"))))
    return state.select("key", (F.col("seen") - 1).alias("n_below"))


def build_hierarchy(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", name_col: str = "name", order_col: str = "updated_at", max_volume: int = 4_000_000, paths: bool = True) -> DataFrame:
    """One row per node: id, name, root_id, depth, path, ancestor_ids, n_descendants, on_loop. See the module's text for the cases.

    Paths and ancestors grow with the depth; ``paths=False`` leaves them empty where only roots and depths are wanted. max_volume:
    the most nodes and ancestor entries a component walked in one task may have; it changes the way, not the result.
    """
    nodes = durable(label_components(newest_nodes(rows, id_col, parent_col, name_col, order_col)))
    cost = F.sum(F.lit(1) + F.greatest("steps", F.lit(0))) if paths else F.count(F.lit(1))
    sizes = durable(nodes.groupBy("component").agg(cost.alias("size")))
    large = sizes.where(F.col("size") > max_volume).select("component")
    n_large = large.count()
    total = sizes.where(F.col("size") <= max_volume).agg(F.sum("size")).first()[0] or 0
    buckets = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-total // max(max_volume // 8, 1)))
    small = nodes.join(large, "component", "left_anti") if n_large else nodes
    walked = small.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).select("bucket", "key", "parent_key", "name").groupBy("bucket").applyInPandas(_walk_buckets(paths), SCHEMA)
    if n_large:
        walked = walked.unionByName(_double_paths(nodes.join(large, "component", "left_semi"), paths))
    ids = nodes.select("key", "id", "name")
    roots = nodes.select(F.col("key").alias("root_key"), F.col("id").alias("root_id"))
    return (
        walked.join(ids, "key").join(roots, "root_key")
        .select("id", "name", "root_id", "depth", F.when((F.col("depth") >= 0) & F.lit(paths), F.concat_ws("/", "names")).alias("path"), F.col("ancestors").alias("ancestor_ids"), F.col("n_below").alias("n_descendants"), "on_loop")
    )


def descendants(hierarchy: DataFrame) -> DataFrame:
    """One row per node and node below it: ancestor_id, descendant_id, distance. As rows, so no node's list is gathered."""
    return hierarchy.select(F.col("id").alias("descendant_id"), F.col("depth"), F.posexplode("ancestor_ids").alias("at", "ancestor_id")).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).cast("long").alias("distance"))


def loops(hierarchy: DataFrame) -> DataFrame:
    """The nodes on a loop, with the loop's smallest id."""
    return hierarchy.where("on_loop").select("id", F.col("root_id").alias("loop_id"))
