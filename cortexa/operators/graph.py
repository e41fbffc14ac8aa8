"""Components, patches, communities and mesh geometry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import distance, triangle_area
from ..sources.shared import checkpoint, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node with a link to another.

    Each round hangs every node's larger neighbours on its smallest one, then
    every node's smaller neighbours on the smallest of them; links with null
    ends or onto themselves count for nothing. The rounds end when the links
    stay as they are: then each node hangs on its component's smallest node.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    pairs = checkpoint(pairs.where("x is not null and y is not null and u > v").select("u", "v").distinct())
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # From a checkpoint, so that adaptive execution can split the join where one node has most of the links.
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s")).select("s.u", F.col("s.m").alias("v"))
        pairs = checkpoint(small.where("u > v").distinct())
        after = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def all_components(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """node, component of every node; one without edges is a component of its own."""
    found = components(edges, "i", "j")
    return nodes.select(F.col(node).alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_component(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Nodes of the largest component (of equals the one with the smallest node)."""
    found = all_components(edges, nodes, node)
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("b")).select(F.col("b.component").alias("component"))
    return found.join(F.broadcast(best), "component", "left_semi").select("node")


def patches(edges: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """node, label, patch, n_nodes: connected pieces of each label above 0."""
    own = labels.where(F.col(label) > 0).select(F.col(node).alias("node"), F.col(label).alias("label"))
    inside = edges.select("i", "j")
    for end in ("i", "j"):
        inside = inside.join(own.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end)
    found = all_components(inside.where("li = lj"), own)
    joined = own.join(found.withColumnRenamed("component", "patch"), "node")
    sizes = joined.groupBy("patch").agg(F.count("*").alias("n_nodes"))
    return joined.join(sizes, "patch").select("node", "label", "patch", "n_nodes")


def mesh_edges(faces: DataFrame) -> DataFrame:
    """i < j: the distinct sides of the triangles (a, b, c)."""
    sides = F.array(*(F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))))
    return faces.select(F.inline(sides)).distinct()


def vertex_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """node, area: a third of the areas of a node's triangles."""
    rows = faces
    for end in ("a", "b", "c"):
        rows = rows.join(vertices.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}{c}") for c in "xyz")), end)
    area = triangle_area(*([F.col(f"{end}{c}") for c in "xyz"] for end in ("a", "b", "c")))
    return rows.select(F.explode(F.array("a", "b", "c")).alias("node"), (area / 3).alias("third")).groupBy("node").agg(F.sum("third").alias("area"))


def without_small_patches(edges: DataFrame, labels: DataFrame, areas: DataFrame, least: float) -> DataFrame:
    """node, label: labels of patches whose area is below ``least`` become -1."""
    found = patches(edges, labels)
    sizes = found.join(areas, "node").groupBy("patch").agg(F.sum("area").alias("patch_area"))
    small = found.join(sizes.where(F.col("patch_area") < least), "patch").select("node", F.lit(True).alias("small"))
    return labels.join(small, "node", "left").select("node", F.when(F.col("small"), -1).otherwise(F.col("label")).alias("label"))


def merged_small_patches(edges: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """node, label: patches of fewer than ``least`` nodes take the commonest label around them.

    All patches are judged on the labels as they came in, so the result does
    not depend on an order; the lowest of equally common labels is taken, and a
    patch without labelled neighbours stays.
    """
    found = patches(edges, labels)
    small = found.where(F.col("n_nodes") < least).select("node", "patch")
    ends = edges.select("i", "j").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
    border = ends.join(small.withColumnRenamed("node", "i"), "i").join(found.select(F.col("node").alias("j"), "label", F.col("patch").alias("other")), "j").where("patch <> other")
    votes = border.groupBy("patch", "label").agg(F.countDistinct("j").alias("n"))
    best = votes.groupBy("patch").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("patch", F.col("b.label").alias("new_label"))
    moved = small.join(best, "patch").select("node", "new_label")
    return labels.join(moved, "node", "left").select("node", F.coalesce("new_label", "label").alias("label"))


def border_nodes(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """Nodes next to a cluster that are not in it."""
    ends = edges.select("i", "j").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
    near = ends.join(cluster.select(F.col("node").alias("i")), "i", "left_semi").select(F.col("j").alias("node")).distinct()
    return near.join(cluster.select("node"), "node", "left_anti")


def geodesics(edges: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """source, node, distance: shortest paths along weighted edges from each source, up to ``limit``.

    Each round relaxes the edges around the nodes reached in the round before;
    the rounds end when no distance shrinks.
    """
    ends = checkpoint(edges.select("i", "j", "w").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")))
    known = checkpoint(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance")).distinct())
    front = known
    while not front.isEmpty():
        step = front.join(ends, F.col("node") == F.col("i")).select("source", F.col("j").alias("node"), (F.col("distance") + F.col("w")).alias("distance")).where(F.col("distance") <= limit)
        step = step.groupBy("source", "node").agg(F.min("distance").alias("distance"))
        both = known.withColumnRenamed("distance", "old").join(step, ["source", "node"], "full")
        both = checkpoint(both.select("source", "node", "old", F.least("old", "distance").alias("distance")))
        front = both.where("old is null or distance < old").select("source", "node", "distance")
        known = both.select("source", "node", "distance")
    return known


#: Ends of edges in one row of a packed graph (some 32 MB), and nodes whose labels are sent to every task (16 MB).
PACKED_ENDS, HELD_NODES = 2_000_000, 1_000_000


def packed_graph(edges: DataFrame, held: int) -> DataFrame:
    """i, j, w (packed, in order of i): both directions of a stored table's edges without loops and weights that are not positive, all of a node in one row."""
    edges = edges.where("i <> j and w > 0")
    blocks = max(1, -(-2 * edges.count() // held))
    ends = edges.select(F.inline(F.array(F.struct("i", "j", "w"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "w"))))

    def pack(table):
        i, j, w = (table[c].to_numpy() for c in "ijw")
        order = np.argsort(i, kind="stable")
        return pa.table({c: pa.array([v[order].tobytes()], pa.binary()) for c, v in zip("ijw", (i, j, w), strict=True)})

    ends = ends.select(F.pmod(F.xxhash64("i"), F.lit(blocks)).alias("b"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w"))
    return ends.groupBy("b").applyInArrow(pack, "i binary, j binary, w binary")


def _voted(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """node, module: each node's label of most votes; the labels, which have a bound, go to all tasks."""

    def pack(table):
        node, module = table["node"].to_numpy(), table["module"].to_numpy()
        order = np.argsort(node)
        return pa.table({"node": pa.array([node[order].tobytes()], pa.binary()), "module": pa.array([module[order].tobytes()], pa.binary())})

    def vote(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, w, node, module = (np.frombuffer(batch.column(c)[k].as_buffer(), float if c == 2 else np.int64) for c in range(5))
                names, at = np.unique(module, return_inverse=True)
                rows, r = np.unique(i, return_inverse=True)
                own = np.full(len(rows), -np.inf)
                np.maximum.at(own, r, w)
                r, m = np.append(r, np.arange(len(rows))), np.append(at[np.searchsorted(node, j)], at[np.searchsorted(node, rows)])
                codes, places = np.unique(r * len(names) + m, return_inverse=True)
                sums = np.floor(np.bincount(places, np.append(w, own)) * 1e9 + 0.5)
                r, m = np.divmod(codes, len(names))
                order = np.lexsort((m, -sums, r))
                first = order[np.searchsorted(r[order], np.arange(len(rows)))]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(names[m[first]])], ["node", "module"])

    one = labels.groupBy().applyInArrow(pack, "node binary, module binary")
    return graph.crossJoin(F.broadcast(one)).mapInArrow(vote, "node long, module long")


def label_propagation(edges: DataFrame, held_nodes: int = HELD_NODES, held_ends: int = PACKED_ENDS) -> DataFrame:
    """node, module: communities by synchronous weighted label propagation.

    Each node takes the label with the largest summed weight among itself (by
    its strongest edge) and its neighbours, the smallest of equals. Deterministic;
    it does not minimise a map equation, so modules differ from such methods'.
    The rounds end when no label changes. Where the labels of an earlier round
    recur, each node takes the smallest label that it has in the cycle. The edges
    are packed once, and up to ``held_nodes`` labels come to them; of more nodes
    votes are joined and grouped.
    """
    edges = stored(edges.select("i", "j", "w").where("i <> j and w > 0"))
    nodes = edges.select(F.explode(F.array(F.col("i").cast("long"), F.col("j").cast("long"))).alias("node")).distinct()
    labels = checkpoint(nodes.select("node", F.col("node").alias("module")))
    if labels.count() <= held_nodes:
        graph = stored(packed_graph(edges, held_ends))
        step = lambda labels: _voted(graph, labels)
    else:
        ends = stored(edges.select(F.inline(F.array(F.struct("i", "j", "w"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "w")))))
        own = stored(ends.groupBy("i").agg(F.max("w").alias("w")))

        def step(labels):
            votes = ends.join(labels.withColumnRenamed("node", "j"), "j").select("i", "module", "w")
            votes = votes.union(own.join(labels.withColumnRenamed("node", "i"), "i").select("i", "module", "w"))
            sums = votes.groupBy("i", "module").agg(F.round(F.sum("w"), 9).alias("s"))
            return sums.groupBy("i").agg(F.min(F.struct((-F.col("s")).alias("s"), "module")).alias("b")).select(F.col("i").alias("node"), F.col("b.module").alias("module"))

    def state(labels: DataFrame):
        return labels.agg(F.count("*"), F.sum(F.xxhash64("node", "module").cast("decimal(38,0)"))).first()

    seen, least = {state(labels): 0}, None
    end = None  # of the cycle, once one is found
    while end is None or len(seen) < end:
        labels = checkpoint(step(labels))
        now = state(labels)
        if end is None:
            length = len(seen) - seen.get(now, len(seen))
            if length == 1:
                return labels
            if length:
                seen, least, end = {}, labels, length - 1
            else:
                seen[now] = len(seen)
        else:
            seen[now] = len(seen)
            least = checkpoint(least.union(labels).groupBy("node").agg(F.min("module").alias("module")))
    return least if least is not None else labels


def nearest_reference(points: DataFrame, references: DataFrame, axes: list[str], within: list[str], point: str, reference: str) -> DataFrame:
    """The nearest reference of each point in the same part; of equals the smaller one.

    References are few for each part; every point is compared to those of its part.
    """
    other = references.select(*within, F.col(reference), *(F.col(a).alias(f"__{a}") for a in axes))
    d = distance([F.col(a) for a in axes], [F.col(f"__{a}") for a in axes])
    pairs = points.join(other, within).select(*within, point, reference, d.alias("distance"))
    best = pairs.groupBy(*within, point).agg(F.min(F.struct("distance", reference)).alias("b"))
    return best.select(*within, point, f"b.{reference}", "b.distance")


def knee(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The point of each curve farthest above the chord between its ends, both axes scaled to [0, 1]."""
    over = Window.partitionBy(*keys)
    scaled = {c: F.try_divide(F.col(c) - F.min(c).over(over), F.max(c).over(over) - F.min(c).over(over)) for c in (x, y)}
    ends = df.groupBy(*keys).agg(F.min_by(y, x).alias("__y0"), F.max_by(y, x).alias("__y1"))
    rising = F.when(F.col("__y1") >= F.col("__y0"), 1.0).otherwise(-1.0)
    rows = df.withColumn("__sx", scaled[x]).withColumn("__sy", scaled[y])
    joined = rows.join(ends, keys) if keys else rows.crossJoin(F.broadcast(ends))
    gap = F.when(rising > 0, F.col("__sy") - F.col("__sx")).otherwise(1 - F.col("__sx") - F.col("__sy"))
    best = F.min(F.struct((-F.abs(gap)).alias("g"), F.col(x).alias("x"), F.col(y).alias("y")))
    return joined.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.x").alias(x), F.col("b.y").alias(y), (-F.col("b.g")).alias("gap"))
