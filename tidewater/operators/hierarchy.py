"""Parent-child links of unknown depth become full hierarchies: path, depth, root, descendants, circles.

Level-wise frontier joins from the roots. The levels of ordinary trees run inside the partition that
holds them (one shuffle, then vectorised joins of the frontier with the child lists). Trees above
`tree_limit` rows, which no task should hold, are joined across the cluster, with reach doubling from join to join, so that
a depth of d takes about log2(d) of them and not d. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import materialize

#: Rows of one tree that a single task may hold; larger trees are joined across the cluster.
TREE_LIMIT = 500_000
#: Rows that one bucket of whole trees holds on average.
BUCKET_ROWS = 100_000
#: Path elements that are built at once.
PATH_ELEMENTS = 1_000_000

RESULT = "tree string, node string, parent string, root string, depth int, cycle string"


def _factor(*columns: np.ndarray) -> np.ndarray:
    """The same small integer for equal rows."""
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), dtype=bool)
    for x in columns:
        y = x[order]
        change[1:] |= y[1:] != y[:-1]
    ids = np.empty(len(order), dtype=np.int64)
    ids[order] = np.cumsum(change)
    return ids


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return shift + np.arange(total)


def walk_levels(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """depth, root and the nodes of each level, of nodes given by their parent's index (-1: a root).

    Nodes that no level reaches, on or below a circle, keep depth -1 and root -1.
    """
    n = len(parent)
    depth, root = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int64)
    has = np.flatnonzero(parent >= 0)
    children = has[np.argsort(parent[has], kind="stable")]
    counts = np.bincount(parent[has], minlength=n)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if n else counts
    frontier = np.flatnonzero(parent < 0)
    depth[frontier], root[frontier] = 0, frontier
    levels = []
    while len(frontier):
        levels.append(frontier)
        k = counts[frontier]
        following = children[_ranges(starts[frontier], k)]
        depth[following] = len(levels)
        root[following] = np.repeat(root[frontier], k)
        frontier = following
    return depth, root, levels


def on_circle(parent: np.ndarray, unreached: np.ndarray) -> np.ndarray:
    """Of the unreached nodes, those on a circle: what stays when childless ones are peeled off."""
    alive = np.zeros(len(parent), dtype=bool)
    alive[unreached] = True
    degree = np.bincount(parent[unreached], minlength=len(parent))
    leaves = unreached[degree[unreached] == 0]
    while len(leaves):
        alive[leaves] = False
        up = parent[leaves]
        np.subtract.at(degree, up, 1)
        up = np.unique(up)
        leaves = up[alive[up] & (degree[up] == 0)]
    return alive


def _paths(names: pa.Array, up: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(nodes, their paths) in pieces of about PATH_ELEMENTS, or of one path; nodes without a root have no path."""
    order = np.argsort(depth, kind="stable")
    lost = order[: int((depth < 0).sum())]
    if len(lost):
        yield lost, pa.nulls(len(lost), pa.list_(pa.string()))
    order = order[len(lost) :]
    ends = np.cumsum(depth[order].astype(np.int64) + 1)
    begin = 0
    while begin < len(order):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PATH_ELEMENTS, "right")))
        nodes = order[begin:end]
        offsets = np.concatenate(([0], ends[begin:end] - done))
        out, now, at = np.empty(int(offsets[-1]), dtype=np.int64), nodes, offsets[1:] - 1
        while len(now):
            out[at] = now
            more = depth[now] > 0
            now, at = up[now[more]], at[more] - 1
        yield nodes, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(out)))
        begin = end


def _local(batch: pa.Table, with_path: bool) -> Iterator[pa.Table]:
    tree, node, parent = (batch.column(k).combine_chunks() for k in ("tree", "node", "parent"))
    n = len(tree)
    codes = pa.concat_arrays([tree.cast(pa.string())]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    both = pa.concat_arrays([node.cast(pa.string()), parent.cast(pa.string())]).dictionary_encode().indices
    nodes = both[:n].to_numpy(zero_copy_only=False).astype(np.int64)
    parents = both[n:].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    # one node per (tree, node); of several parents the least by text, nulls last
    text = parent.fill_null("\U0010ffff").to_numpy(zero_copy_only=False)
    key = _factor(codes.astype(np.int64), nodes)
    order = np.argsort(key, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = key[order][1:] != key[order][:-1]
    if not first.all():
        group = np.cumsum(first) - 1
        best: dict[int, int] = {}
        for g in np.unique(group[~first]):
            rows = order[group == g] if len(order) < 64 else order[np.searchsorted(group, g) : np.searchsorted(group, g, side="right")]
            best[g] = min(rows, key=lambda i: text[i])
        keep = order[first]
        for g, i in best.items():
            keep[g] = i
    else:
        keep = order
    codes, nodes, parents = codes[keep], nodes[keep], parents[keep]
    m = len(keep)
    ids = _factor(np.concatenate((codes, codes)).astype(np.int64), np.concatenate((nodes, parents)))
    at = np.full(int(ids.max(initial=-1)) + 1, -1, dtype=np.int64)
    at[ids[:m]] = np.arange(m)
    up = np.where(parents >= 0, at[ids[m:]], -1)
    depth, root, _ = walk_levels(up)
    lost = np.flatnonzero(depth < 0)
    mark = np.full(m, None, dtype=object)
    if len(lost):
        ring = on_circle(up, lost)
        mark[lost] = np.where(ring[lost], "on", "below")
    out_tree, out_node, out_parent = (x.take(pa.array(keep)) for x in (tree, node, parent))
    names = out_node.to_numpy(zero_copy_only=False)
    roots = np.where(root >= 0, names[np.maximum(root, 0)], "") if m else names
    out = {
        "tree": out_tree, "node": out_node, "parent": out_parent,
        "root": pa.array(roots, pa.string()), "depth": pa.array(depth, pa.int32()), "cycle": pa.array(mark, pa.string()),
    }
    whole = pa.table(out)
    if not with_path:
        yield whole
        return
    text = out_node.cast(pa.string())
    for nodes, paths in _paths(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text, up, depth):
        yield whole.take(pa.array(nodes)).append_column("path", paths)


def _distributed(links: DataFrame, with_path: bool) -> DataFrame:
    """The same rows by joins across the cluster, for trees too large for a task.

    Every node knows an ancestor (`to`) and the way to it; joining that with what the ancestor knows doubles the reach.
    A node is done once its ancestor is a root. Depths along a path have no gaps, so a join that completes no further
    node means that the rest never will: these nodes are on or below circles. Joins are on (tree, node), unique on one side.
    """
    nodes = materialize(links.groupBy("tree", "node").agg(F.min("parent").alias("parent")))
    ids = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("has"))
    linked = nodes.join(ids, ["tree", "parent"], "left")
    top = F.col("has").isNull()
    way = F.when(top, F.array().cast("array<string>")).otherwise(F.array("node")) if with_path else F.lit(None).cast("array<string>")
    start = linked.select("tree", "node", "parent", F.when(top, F.col("node")).otherwise(F.col("parent")).alias("to"), F.when(top, 0).otherwise(1).alias("depth"), way.alias("way"), top.alias("done"))
    start = materialize(start)
    done, going = [start.where("done")], start.where("not done")
    before = going.count()
    while before:
        known = going
        for x in done:
            known = known.unionByName(x)
        far = known.select("tree", F.col("node").alias("to"), F.col("to").alias("far"), F.col("depth").alias("more"), F.col("way").alias("ahead"), F.col("done").alias("there"))
        # only nodes on their way are written again
        moved = materialize(going.join(far, ["tree", "to"]).select(
            "tree", "node", "parent", F.col("far").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("ahead", "way").alias("way"), F.col("there").alias("done")
        ))
        done.append(moved.where("done"))
        going = moved.where("not done")
        now = going.count()
        if now == before:
            break
        before = now
    reached = done[0]
    for x in done[1:]:
        reached = reached.unionByName(x)
    path = F.concat(F.array("to"), F.col("way")) if with_path else F.lit(None).cast("array<string>")
    result = reached.select("tree", "node", "parent", F.col("to").alias("root"), "depth", F.lit(None).cast("string").alias("cycle"), path.alias("path"))
    lost = materialize(going.select("tree", "node", "parent"))
    if not lost.isEmpty():
        # Jumping 2^k parents up maps the lost nodes onto the circles once 2^k passes every tail; then the image stays as large.
        jump, before = lost.select("tree", "node", F.col("parent").alias("to")), -1
        while True:
            hit = jump.select("tree", F.col("to").alias("node")).distinct()
            now = hit.count()
            if now == before:
                break
            before = now
            jump = materialize(
                jump.alias("a").join(jump.select("tree", F.col("node").alias("to"), F.col("to").alias("far")), ["tree", "to"]).select("tree", "node", F.col("far").alias("to"))
            )
        ring = hit.withColumn("cycle", F.lit("on"))
        marked = lost.join(ring, ["tree", "node"], "left").select(
            "tree", "node", "parent", F.lit("").alias("root"), F.lit(-1).alias("depth"),
            F.coalesce("cycle", F.lit("below")).alias("cycle"), F.lit(None).cast("array<string>").alias("path"),
        )
        result = result.unionByName(marked)
    return result if with_path else result.drop("path")


def hierarchies(links: DataFrame, with_path: bool = False, tree_limit: int = TREE_LIMIT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per node of `links` (tree, node, parent: strings): parent, root, depth, circle mark, path.

    A node whose parent is null or absent from its tree is a root of depth 0. Nodes on or below a circle get
    root '' and depth -1, `cycle` tells 'on' from 'below', their path is null. Rows without tree or node
    are no nodes; repeated rows count once; of several parents of a node the least text counts; other
    columns are ignored; no rows give an empty result.

    Tree sizes are counted first, with map-side combine. Buckets of whole trees are formed by hash, as many
    as the rows need, so a task holds about `bucket_rows` rows plus at most one tree of `tree_limit` rows.
    """
    spark = links.sparkSession
    rows = links.select("tree", "node", "parent").where(F.col("tree").isNotNull() & F.col("node").isNotNull())
    sizes = rows.groupBy("tree").count()
    total, n_large = sizes.agg(
        F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > tree_limit)
    ).first()
    large = materialize(sizes.where(F.col("count") > tree_limit).select("tree")) if n_large else None
    buckets = max(1, -(-total // bucket_rows), int(spark.conf.get("spark.sql.shuffle.partitions", "200")) if total > bucket_rows else 1)
    small = rows.join(large, "tree", "left_anti") if n_large else rows
    schema = RESULT + (", path array<string>" if with_path else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held and sum(len(b) for b in held):
            for part in _local(pa.Table.from_batches(held), with_path):
                yield from part.to_batches(max_chunksize=20_000)

    out = small.repartition(buckets, "tree").mapInArrow(run, schema)
    return out.unionByName(_distributed(rows.join(large, "tree", "left_semi"), with_path)) if n_large else out


def descendants(tree: DataFrame) -> DataFrame:
    """(tree, ancestor, node, distance): every descendant of each node, from the paths of `hierarchies`.

    Ancestor pairs run along the paths only, so their number is the sum of the depths. Nodes on or below a
    circle have no path and no pairs; `descendant_counts` covers them.
    """
    return tree.where(F.col("path").isNotNull()).select(
        "tree", "node", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "ancestor")
    ).select("tree", "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


COUNTS = "tree string, node string, descendants long, height int"


def around_circles(parent: np.ndarray, below: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descendants and height of nodes that all lie on circles, from what hangs below each off its circle.

    A node on a circle reaches all other nodes on it and all that hangs below any of them; the circle is walked
    once, so the node itself is no descendant of its own.
    """
    count, reach, seen = np.empty(len(parent), dtype=np.int64), np.empty(len(parent), dtype=np.int64), np.zeros(len(parent), dtype=bool)
    for first in range(len(parent)):
        if seen[first]:
            continue
        ring, x = [], first
        while not seen[x]:
            seen[x] = True
            ring.append(x)
            x = parent[x]
        k, at = len(ring), np.arange(len(ring))
        # the m-th child along the circle of ring[i] is ring[i - m], at the distance m: the greatest of m + height
        own = height[ring] - at
        up_to = np.maximum.accumulate(own)
        after = np.append(np.maximum.accumulate(own[::-1])[::-1][1:], np.iinfo(np.int64).min // 2)
        reach[ring] = at + np.maximum(up_to, after + k)
        count[ring] = k - 1 + below[ring].sum()
    return count, reach


def _circle_counts(table: pa.Table) -> pa.Table:
    """The nodes of one tree that are on circles: tree, node, parent, below, height."""
    node, parent = table.column("node").combine_chunks(), table.column("parent").combine_chunks()
    up = pc.index_in(parent, node).to_numpy(zero_copy_only=False).astype(np.int64)
    below, height = (table.column(k).to_numpy().astype(np.int64) for k in ("below", "height"))
    count, reach = around_circles(up, below, height)
    return pa.table({"tree": table.column("tree"), "node": node, "descendants": count, "height": pa.array(reach.astype(np.int32))})


def descendant_counts(links: DataFrame, **limits: int) -> DataFrame:
    """(tree, node, descendants, height) of every node, 0 and 0 where it has none.

    Descendants are all nodes reached through children, each once and never the node itself; the height is the
    distance of the farthest. So a node below a circle has its subtree, and a node on a circle the rest of the circle
    and what hangs below any of its nodes. The unreached nodes are walked again from the circles with the circles'
    links cut. A task holds the circle nodes of one tree. `limits` are those of `hierarchies`.
    """
    nodes = materialize(hierarchies(links, with_path=True, **limits))
    lost = nodes.where(F.col("cycle").isNotNull())
    cut = materialize(hierarchies(lost.withColumn("parent", F.when(F.col("cycle") == "below", F.col("parent"))), with_path=True, **limits))
    pairs = descendants(nodes).unionByName(descendants(cut.withColumn("path", F.slice("path", 2, F.size("path"))).withColumn("depth", F.col("depth") - 1).where("depth >= 0")))
    alone = nodes.where("cycle is null or cycle = 'below'").select("tree", F.col("node").alias("ancestor"), F.lit(None).cast("int").alias("distance"))
    plain = pairs.select("tree", "ancestor", "distance").unionByName(alone).groupBy("tree", F.col("ancestor").alias("node")).agg(
        F.count("distance").alias("descendants"), F.coalesce(F.max("distance"), F.lit(0)).alias("height")
    )
    hanging = cut.groupBy("tree", F.col("root").alias("node")).agg((F.count("*") - 1).alias("below"), F.max("depth").alias("height"))
    on = lost.where("cycle = 'on'").select("tree", "node", "parent").join(hanging, ["tree", "node"])
    return plain.unionByName(on.groupBy("tree").applyInArrow(_circle_counts, COUNTS))
