"""Parent-child links to full hierarchies (problem 7).

Components are found by pointer doubling along the parent links (each node has one
parent at most), in as many rounds as the logarithm of the longest line. Whole
components are then co-located in buckets and walked by an iterative depth-first
traversal with node colouring; an edge to a node still on the stack closes a cycle.

Scale: only linked records enter the rounds, and a node leaves them as soon as its
root is known. State is cut to the shared folder each round, so lost executors cost
one round. A component above ``walk_limit`` nodes never enters one task: depth,
descendants and path of its nodes are doubled in the same way, where each round is
a join and a map-side combined sum (exact at any size or depth). Joins are against
a side of unique keys, so a hub that a third of all rows name is split by the
adaptive skew join.

Defined results: null and blank keys are no records; blank references are none; a
reference to no record gives no link; of repeated records the first delivery
counts; if several records name one item as their successor the smallest key is the
parent; records without links give no row; an empty table gives none. The members of
one cycle are one row of :func:`cycles` (a cycle is as long as its contradiction).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.keys import norm_key
from quillspan.session import cut, drop_cut

#: Largest component walked in one task: about 100 bytes a node.
WALK_LIMIT = 1_000_000

SCHEMA = "item_id string, root_item_id string, depth int, n_descendants int, kind string"


def parent_links(
    rows: DataFrame,
    key: str = "item_id",
    parent: str = "supersedes_item_id",
    child: str = "superseded_by_item_id",
    delivered: str = "loaded_at",
) -> DataFrame:
    """(node, parent): the parent a record names, else the record that names it."""
    items = (
        rows.select(
            norm_key(key).alias("node"), norm_key(parent).alias("up"), norm_key(child).alias("down"), F.col(delivered).alias("at")
        )
        .filter("node is not null")
        .groupBy("node")
        .agg(F.min(F.struct("at", "up", "down")).alias("r"))
        .select("node", "r.up", "r.down")
    )
    named = items.filter("down is not null").groupBy(F.col("down").alias("node")).agg(F.min("node").alias("by"))
    # a name not in items is no link: parents named from above exist by themselves
    said = items.filter("up is not null").select("node", F.col("up").alias("parent"))
    there = items.select(F.col("node").alias("parent"))
    said = said.join(there, "parent", "left_semi").select("node", "parent")
    told = items.filter("up is null").select("node").join(named, "node").select("node", F.col("by").alias("parent"))
    return said.unionByName(told)


def components(kids: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """((node, parent, comp, loops) of every node with a parent, nodes on cycles, the cuts
    these are read from).

    comp is the root, or for a component with a cycle the smallest node on it.
    """
    state = cut(
        kids.select("node", "parent", F.col("parent").alias("ptr"), F.least("node", "parent").alias("low"), F.lit(False).alias("done"))
    )
    reach, finished, before, steps = 1, None, -1, [state]
    while True:
        t = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("t_ptr"), F.col("low").alias("t_low"), F.col("done").alias("t_done"))
        if finished is not None:
            t = t.unionByName(
                finished.select(F.col("node").alias("ptr"), F.col("ptr").alias("t_ptr"), F.lit(None).cast("string").alias("t_low"), F.lit(True).alias("t_done"))
            )
        step = cut(
            state.join(t, "ptr", "left").select(
                "node",
                "parent",
                F.coalesce("t_ptr", "ptr").alias("ptr"),
                F.least("low", "t_low").alias("low"),
                (F.col("t_ptr").isNull() | F.col("t_done")).alias("done"),
            )
        )
        steps.append(step)
        ended = step.filter("done").select("node", "parent", "ptr")
        finished = ended if finished is None else finished.unionByName(ended)
        state = step.filter("not done")
        active = state.count()
        reach *= 2
        # below a root someone always finishes, so a count that stays is of cycles alone;
        # after as many steps as there are nodes left every pointer stands on its cycle
        if active == 0 or (active == before and reach >= active):
            break
        before = active
    rings = state.select(F.col("ptr").alias("node")).distinct()
    ring_low = state.join(rings, "node", "left_semi").select(F.col("node").alias("ptr"), F.col("low").alias("comp"))
    looped = state.join(ring_low, "ptr").select("node", "parent", "comp", F.lit(True).alias("loops"))
    trees = finished.select("node", "parent", F.col("ptr").alias("comp"), F.lit(False).alias("loops"))
    return trees.unionByName(looped), rings, steps


def walk(node: np.ndarray, parent: np.ndarray, paths: bool = False) -> dict[str, list]:
    """Iterative depth-first traversal of whole components, with node colouring.

    ``parent`` holds None at roots. A component without a root is entered at its
    smallest node first seen white after climbing to the ring.
    """
    n = len(node)
    index = {v: i for i, v in enumerate(node)}
    up = np.array([index.get(p, -1) if p is not None else -1 for p in parent], np.int64)
    order = np.lexsort((np.arange(n), up))
    first = np.searchsorted(up[order], np.arange(n))
    last = np.searchsorted(up[order], np.arange(n), side="right")
    white, grey, black = 0, 1, 2
    colour = np.zeros(n, np.int8)
    depth, below, top, kind = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int8)
    trail: list[list[str] | None] = [None] * n

    def descend(start: int, sort: int, ring: frozenset[int] = frozenset()) -> None:
        stack = [(start, first[start])]
        colour[start] = grey
        kind[start] = sort
        if paths:
            trail[start] = [node[start]]
        while stack:
            v, at = stack[-1]
            if at < last[v]:
                stack[-1] = (v, at + 1)
                w = order[at]
                if colour[w] != white or w in ring:
                    continue  # a back edge: its ring is already known
                colour[w] = grey
                depth[w], top[w], kind[w] = depth[v] + 1, top[v], 2 if sort else 0
                if paths:
                    trail[w] = [*trail[v], node[w]]
                stack.append((w, first[w]))
            else:
                colour[v] = black
                stack.pop()
                if stack:
                    below[stack[-1][0]] += below[v] + 1

    for r in np.flatnonzero(up < 0):
        descend(int(r), 0)
    for s in range(n):
        if colour[s] != white:
            continue
        # climb with grey marks until a grey node: the back edge that closes the ring
        chain, v = [], s
        mark: dict[int, int] = {}
        while v not in mark:
            mark[v] = len(chain)
            chain.append(v)
            v = int(up[v])
        ring = chain[mark[v] :]
        low = min(ring, key=lambda i: node[i])
        members = frozenset(ring)
        for c in ring:
            top[c] = low
            descend(c, 1, members)
            top[c] = low
        total = sum(int(below[c]) for c in ring) + len(ring) - 1
        for c in ring:
            below[c] = total
    names = ("tree", "cycle", "hanging")
    out = {
        "item_id": list(node),
        "root_item_id": [node[i] for i in top],
        "depth": depth.astype(np.int32).tolist(),
        "n_descendants": below.astype(np.int32).tolist(),
        "kind": [names[k] for k in kind],
    }
    if paths:
        out["path"] = trail
    return out


def _walk_bucket(paths: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = pdf["parent"].to_numpy(dtype=object)
        return pd.DataFrame(walk(pdf["node"].to_numpy(dtype=object), np.where(pd.isna(parent), None, parent), paths))

    return run


def _doubled(nodes: DataFrame, rings: DataFrame, paths: bool) -> DataFrame:
    """The result for components too large for one task, by doubling alone."""
    on = rings.select("node", F.lit(True).alias("ring"))
    base = nodes.join(on, "node", "left").withColumn("ring", F.col("ring").isNotNull())
    state = cut(
        base.select(
            "node",
            "comp",
            "loops",
            "ring",
            F.when(~F.col("ring"), F.col("parent")).alias("ptr"),
            F.when(F.col("ring") | F.col("parent").isNull(), 0).otherwise(1).alias("depth"),
            F.lit(1).cast("long").alias("val"),
            F.when(F.lit(paths), F.array("node")).alias("path"),
        )
    )
    while state.filter("ptr is not null").limit(1).count():
        sums = state.filter("ptr is not null").groupBy(F.col("ptr").alias("node")).agg(F.sum("val").alias("more"))
        t = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("t_ptr"), F.col("depth").alias("t_depth"), F.col("path").alias("t_path"))
        last, state = state, cut(
            state.join(sums, "node", "left")
            .join(t, "ptr", "left")
            .select(
                "node",
                "comp",
                "loops",
                "ring",
                F.col("t_ptr").alias("ptr"),
                (F.col("depth") + F.coalesce("t_depth", F.lit(0))).alias("depth"),
                (F.col("val") + F.coalesce("more", F.lit(0))).alias("val"),
                F.when(F.col("ptr").isNull() | F.lit(not paths), F.col("path")).otherwise(F.concat("t_path", "path")).alias("path"),
            )
        )
        drop_cut(last)
    total = state.filter("loops").groupBy("comp").agg(F.count("*").alias("total"))
    out = state.join(total, "comp", "left").select(
        F.col("node").alias("item_id"),
        F.col("comp").alias("root_item_id"),
        F.col("depth").cast("int").alias("depth"),
        (F.when(F.col("ring"), F.col("total")).otherwise(F.col("val")) - 1).cast("int").alias("n_descendants"),
        F.when(~F.col("loops"), "tree").when(F.col("ring"), "cycle").otherwise("hanging").alias("kind"),
        "path",
    )
    return out if paths else out.drop("path")


def hierarchy(links: DataFrame, paths: bool = False, walk_limit: int = WALK_LIMIT, buckets: int | None = None) -> DataFrame:
    """(item_id, root_item_id, depth, n_descendants, kind[, path]) of linked nodes.

    The path is an array from the root on. On a cycle it is the node alone; below one it
    starts at the cycle's node.
    """
    spark = links.sparkSession
    kids = cut(links)
    comps, rings, steps = components(kids)
    roots = (
        comps.filter("not loops")
        .select(F.col("comp").alias("node"), F.lit(None).cast("string").alias("parent"), "comp", "loops")
        .distinct()
    )
    nodes = cut(comps.unionByName(roots))
    rings = cut(rings)
    for done in (kids, *steps):
        drop_cut(done)
    big = nodes.groupBy("comp").count().filter(F.col("count") > walk_limit).select("comp")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = SCHEMA + (", path array<string>" if paths else "")
    run = _walk_bucket(paths)
    if big.limit(1).count() == 0:
        small, large = nodes, None
    else:
        small, large = nodes.join(big, "comp", "left_anti"), nodes.join(big, "comp", "left_semi")
    walked = small.groupBy(F.pmod(F.xxhash64("comp"), F.lit(n)).alias("bucket")).applyInPandas(run, schema)
    return walked if large is None else walked.unionByName(_doubled(cut(large), rings, paths))


def descendants(links: DataFrame, walk_limit: int = WALK_LIMIT) -> DataFrame:
    """(item_id, descendant_id): each node with every other one reachable downwards."""
    found = hierarchy(links, paths=True, walk_limit=walk_limit)
    # on a path all but the node itself are above it; the first of a looped one stands
    # for its whole cycle
    tree = F.col("kind") == "tree"
    above = F.when(tree, F.slice("path", 1, F.size("path") - 1)).otherwise(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0))))
    lines = found.select(F.explode(above).alias("item_id"), F.col("item_id").alias("descendant_id"))
    looped = found.filter(~tree).select("root_item_id", F.col("item_id").alias("descendant_id"))
    ring = found.filter("kind = 'cycle'").select("root_item_id", "item_id")
    around = ring.join(looped, "root_item_id").filter("item_id <> descendant_id").select("item_id", "descendant_id")
    return lines.unionByName(around)


def cycles(links: DataFrame) -> DataFrame:
    """(root_item_id, back_edge_from, n_members, members): each cycle once, with the edge
    that closes a descent from its smallest member, and its members in order."""
    found = hierarchy(links).filter("kind = 'cycle'")
    rows = found.groupBy("root_item_id").agg(F.count("*").cast("int").alias("n_members"), F.sort_array(F.collect_list("item_id")).alias("members"))
    back = links.select(F.col("node").alias("root_item_id"), F.col("parent").alias("back_edge_from"))
    return rows.join(back, "root_item_id").select("root_item_id", "back_edge_from", "n_members", "members")
