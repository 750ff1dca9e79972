"""Hierarchical density clustering (HDBSCAN) with one neighbour to a core.

With min_samples 1 mutual reachability is the distance itself, so that the hierarchy is
that of single linkage and needs only a minimum spanning tree. Each pair of blocks gives
its pairs within a radius that joins nearly all vectors, or the spanning tree of its own
distances where these are many: by the cycle property the forest within the radius is
among those edges, and what it leaves apart is joined after it. Trees of neighbouring pairs are merged while a task meets at most MERGED
vectors; beyond that rounds of shortest edges out of each component finish the tree.

The hierarchy grows from below, by subtrees. Edges up to a distance, chosen so that the
components they make fit a task, are condensed component by component, each task holding
those of its partition. A component goes up as one node: its size, and of the cluster
that is still open in it the sums that its mass will follow from. Clusters that end leave
as rows, points leave with the cluster that they fall out of. If one distance alone makes
a component that no task can hold, its nodes meet at one split, which is a grouping. What
is selected follows from the clusters' table, by pointer jumping if it has more than TASK
rows. A task never holds more than about TASK edges or clusters, and nothing but quantiles and counts goes through the driver; a
tree that adds point by point to one component takes a round for TASK of them.

Clusters are those of greatest excess of mass (Campello et al., 2013) or the leaves; one that is born
below ``epsilon`` gives way to its first ancestor born above it (Malzer and Baum, 2020).
The root is never a cluster. Merges at equal distances are one split, so that ties don't
depend on an order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace
from functools import reduce
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from certloom.operators.graph import components
from certloom.operators.lineage import Tables, cut
from certloom.operators.order import numbered
from certloom.operators.pairs import BLOCK, METRICS, block_pairs, block_tiles, nearest_of

#: Vectors of which a task merges trees, and edges that a task condenses.
MERGED, TASK = 65_536, 200_000
#: Vectors beyond which a tree is sought within a radius first, vectors that the radius is
#: found by and how many others each has within it, and near pairs for each vector of a tile
#: up to which they go on as they are.
SOUGHT_FROM, SAMPLE, NEAR, DENSE = 4_096, 256, 8, 2
#: What 1 / distance is cut at.
LARGEST = 1e12
EDGES = "p long, q long, a long, b long, distance double"


class Sets:
    """Disjoint sets of numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def tree_edges(ids: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of a minimum spanning forest over candidate edges, in order, ties by ids."""
    low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    sets, found = Sets(len(ids)), []
    for e in np.lexsort((high, low, d)).tolist():
        a, b = sets.find(int(i[e])), sets.find(int(j[e]))
        if a != b:
            sets.up[a] = b
            found.append((int(low[e]), int(high[e]), float(d[e])))
            if len(found) == len(ids) - 1:
                break
    return found


def dense_tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of a minimum spanning tree over a whole matrix of distances, in
    which pairs that don't count are infinite."""
    n = len(d)
    near, via, out = d[0].copy(), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    out[0] = False
    i, j, length = np.zeros(max(n - 1, 0), dtype=np.int64), np.zeros(max(n - 1, 0), dtype=np.int64), np.zeros(max(n - 1, 0))
    for step in range(n - 1):
        left = np.flatnonzero(out)
        new = left[near[left].argmin()]
        i[step], j[step], length[step] = via[new], new, near[new]
        out[new] = False
        closer = out & (d[new] < near)
        near[closer], via[closer] = d[new][closer], new
    return i, j, length


def tile_tree(ids: np.ndarray, idb: np.ndarray, d: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, id, distance) of the spanning tree of one tile of distances."""
    if not same:
        ids, n = np.concatenate([ids, idb]), len(ids)
        across, d = d, np.full((len(ids), len(ids)), np.inf)
        d[:n, n:], d[n:, :n] = across, across.T
    i, j, length = dense_tree(d)
    return ids[i], ids[j], length


def candidate_edges(vectors: DataFrame, metric: str = "cosine", most: float = np.inf) -> DataFrame:
    """(p, q, a, b, distance): of all pairs of blocks p, q what a spanning forest of the pairs
    within ``most`` needs: those pairs, or the tile's spanning tree where they are many more."""
    measure = METRICS[metric]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, q, (ids, x), (idb, y) in chain.from_iterable(block_tiles(frame)):
                d = measure(x, y)
                at = np.flatnonzero(d <= most) if np.isfinite(most) else None
                if at is not None and len(at) <= DENSE * (len(ids) + len(idb)):
                    i, j = np.divmod(at, len(idb))
                    a, b, length = ids[i], idb[j], d[i, j]
                    if p == q:
                        a, b, length = (v[a < b] for v in (a, b, length))
                else:
                    a, b, length = tile_tree(ids, idb, d, p == q)
                    a, b, length = (v[length <= most] for v in (a, b, length))
                if len(a):
                    yield pd.DataFrame({"p": p, "q": q, "a": np.minimum(a, b), "b": np.maximum(a, b), "distance": length})

    return block_pairs(vectors).mapInPandas(run, EDGES)


def joining_radius(vectors: DataFrame, metric: str) -> float:
    """A radius within which nearly every vector has a few others, from a bounded sample by a
    hash of the ids. Any radius gives the same tree; this one leaves little to do beyond it."""
    measure = METRICS[metric]
    sample = np.array([r["vector"] for r in vectors.orderBy(F.xxhash64("entity_id", F.lit(7)), "entity_id").limit(SAMPLE).collect()], dtype=np.float64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                d = measure(sample, np.array([np.asarray(v, dtype=np.float64) for v in frame["vector"]]))
                k = min(NEAR + 1, d.shape[1])
                least = np.partition(d, k - 1, axis=1)[:, :k]
                yield pd.DataFrame({"at": np.repeat(np.arange(len(sample)), k), "distance": least.ravel()})

    found = vectors.mapInPandas(run, "at long, distance double")
    kth = found.groupBy("at").agg(F.element_at(F.sort_array(F.collect_list("distance")), NEAR + 1).alias("d"))  # itself is one
    return float(np.quantile([r["d"] for r in kth.collect()], 0.98))


def merged(edges: DataFrame) -> DataFrame:
    """The forests of two by two pairs of blocks as one."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([frame["a"], frame["b"]]))
        rows = tree_edges(ids, np.searchsorted(ids, frame["a"]), np.searchsorted(ids, frame["b"]), frame["distance"].to_numpy())
        return pd.DataFrame(rows, columns=["a", "b", "distance"]).assign(p=frame["p"].iloc[0], q=frame["q"].iloc[0])[["p", "q", "a", "b", "distance"]]

    halved = edges.withColumns({"p": F.shiftright("p", 1), "q": F.shiftright("q", 1)})
    return halved.groupBy("p", "q").applyInPandas(run, EDGES)


def least_edges(edges: DataFrame, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(a, b, distance) of a minimum spanning forest over any edges, in rounds; ``ends``: the
    columns of what they connect, if not their own ids.

    Each component picks its shortest edge outward (ties by ids), picked edges join
    components, and of the edges between two components the shortest goes on.
    """
    tables, tree, number = Tables(edges.sparkSession), None, 0
    edge = F.struct("distance", "a", "b")
    left = tables.keep("left", edges.select(F.col(ends[0]).alias("x"), F.col(ends[1]).alias("y"), edge.alias("e")))
    while not left.isEmpty():
        both = left.union(left.select("y", "x", "e"))
        picked = cut(both.groupBy("x").agg(F.min("e").alias("e")).select("e").distinct().join(left, "e").select("x", "y", "e"))
        rows = picked.select("e.a", "e.b", "e.distance")
        tree = rows if tree is None else tree.unionByName(rows)
        labels = tables.keep(f"labels{number}", components(picked.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        for side in ("x", "y"):
            left = left.join(labels.select(F.col("node").alias(side), F.col("label").alias("_to")), side).withColumn(side, F.col("_to")).drop("_to")
        across = left.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("e").alias("e"))
        left = tables.keep("left", across)
        tables.drop(f"labels{number}")
        number += 1
    found = edges.sparkSession.createDataFrame([], "a long, b long, distance double") if tree is None else cut(tree)
    tables.drop_all()
    return found


def spanning_forest(vectors: DataFrame, metric: str = "cosine", most: float = np.inf) -> DataFrame:
    """(a, b, distance) of a minimum spanning forest of the pairs within ``most``."""
    tables = Tables(vectors.sparkSession)
    edges = tables.keep("edges", candidate_edges(vectors.select("entity_id", "vector"), metric, most))
    last, vectors_each = edges.agg(F.max("q")).first()[0] or 0, 2 * BLOCK
    while last > 0 and 2 * vectors_each <= MERGED:
        edges, last, vectors_each = tables.keep("edges", merged(edges)), last >> 1, 2 * vectors_each
    own = edges.select("a", "b", "distance")
    # one block gives a forest only as a tile's tree
    forest = cut(own if last == 0 and most == np.inf else least_edges(own))
    tables.drop_all()
    return forest


def spanning_tree(vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """(a, b, distance) of a minimum spanning tree: an edge less than there are ids.

    Of many vectors first the forest within a radius that joins nearly all of them, as most
    pairs are farther and none of those that join the same component is in the tree. The
    rest, what is not in the largest component, is joined by its own tree and by the nearest
    vector of that component to each.
    """
    vectors = vectors.select("entity_id", "vector")
    n = vectors.count()
    if n <= SOUGHT_FROM:
        return spanning_forest(vectors, metric)
    tables = Tables(vectors.sparkSession)
    forest = tables.keep("forest", spanning_forest(vectors, metric, joining_radius(vectors, metric)))
    labels = tables.keep("labels", components(forest.select("a", "b")))
    largest = labels.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    if largest is None or n - largest["count"] > n // 4:
        tables.drop_all()
        return spanning_forest(vectors, metric)
    core = labels.where(F.col("label") == largest["label"]).select(F.col("node").alias("entity_id"))
    rest = tables.keep("rest", vectors.join(core, "entity_id", "left_anti"))
    out = forest
    if not rest.isEmpty():
        inner = vectors.join(core, "entity_id", "left_semi").withColumnRenamed("entity_id", "target")
        links = nearest_of(rest, inner, metric).select(F.col("entity_id").alias("a"), F.col("target").alias("b"), "distance")
        more = tables.keep("more", links.unionByName(spanning_tree(rest, metric)))
        for side in ("a", "b"):
            of = labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}"))
            more = more.join(of, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
        out = forest.unionByName(least_edges(more.where("_a <> _b"), ("_a", "_b")))
    tree = cut(out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance"))
    tables.drop_all()
    return tree


# the hierarchy


@dataclass(slots=True)
class Node:
    """A part of the hierarchy that is still to be joined: ``members`` while it is smaller
    than a cluster, else the open ``cluster`` with what its mass follows from."""

    size: int
    first: int
    members: list[int]
    cluster: str | None = None
    weight: float = 0.0  # sum of 1 / distance over the points that have left
    below: float = 0.0  # mass of the best selection among the clusters below
    parted: bool = False  # there are clusters below


FIELDS = [f.name for f in fields(Node)]


def inverse(distance: float) -> float:
    return min(1 / distance, LARGEST) if distance > 0 else LARGEST


def joined(kids: list[Node], distance: float, least: int, closed: list[tuple], left: list[tuple]) -> Node:
    """The node that ``kids`` make at a distance; ended clusters go to ``closed`` as
    (cluster, parent, birth, parted, greatest), points to ``left`` as (id, cluster)."""
    lam, size, first = inverse(distance), sum(k.size for k in kids), min(k.first for k in kids)
    big, small = [k for k in kids if k.cluster], [p for k in kids for p in k.members]
    if not big and size < least:
        return Node(size, first, small)
    if len(big) == 1:
        out = replace(big[0], size=size, first=first, weight=big[0].weight + lam * len(small))
    else:
        out = Node(size, first, [], f"{first}:{size}", lam * size, 0.0, bool(big))
        for k in big:
            mass = k.weight - lam * k.size
            greatest = not k.parted or mass >= k.below
            closed.append((k.cluster, out.cluster, distance, k.parted, greatest))
            out.below += mass if greatest else k.below
    left += [(p, out.cluster) for p in small]
    return out


def grown(nodes: dict[int, Node], a: list[int], b: list[int], distance: list[float], least: int) -> tuple[dict[int, Node], list[tuple], list[tuple]]:
    """(roots, closed, left) after all edges between nodes, which are in rising order;
    edges of one distance make one split."""
    up, closed, left = {x: x for x in nodes}, [], []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    at = 0
    while at < len(a):
        end, parts = at, {}
        while end < len(a) and distance[end] == distance[at]:
            x, y = find(a[end]), find(b[end])
            if x != y:
                up[y] = x
                parts[x] = parts.pop(x, [x]) + parts.pop(y, [y])
            end += 1
        for root, kids in parts.items():
            nodes[root] = joined([nodes.pop(k) for k in kids], distance[at], least, closed, left)
        at = end
    return nodes, closed, left


CLOSED = "cluster string, parent string, birth double, parted boolean, greatest boolean"
#: Nodes and edges of a step, and what it makes: nodes, ended clusters and points that leave.
_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "longs": T.ArrayType(T.LongType())}
_COLUMNS = "kind string, component long, a long, b long, distance double, node long, size long, first long, members longs, cluster string, weight double, below double, parted boolean, entity_id long, parent string, birth double, greatest boolean"
_STEP = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in _COLUMNS.split(", "))])


def _filled(df: DataFrame) -> DataFrame:
    """With all columns of a step, null where ``df`` has none."""
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in _STEP])


def condensed_step(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None, least: int, tasks: int) -> DataFrame:
    """Rows of three kinds (node, closed, left) of the components that edges make.

    ``labels``: the component of each node; without them all fit one task.
    """
    if labels is not None:
        named = labels.select("node", F.col("label").alias("component"))
        nodes, edges = nodes.join(named, "node"), edges.join(named.withColumnRenamed("node", "a"), "a")
    of_nodes, of_edges = nodes.withColumn("kind", F.lit("node")), edges.withColumn("kind", F.lit("edge"))
    arrow = to_arrow_schema(_STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, lists = {}, ([], [], [])
        for batch in batches:  # of a row only what its kind has, as there are many columns
            kinds = batch.column("kind")
            for r in batch.filter(pc.equal(kinds, "node")).select(["node", *FIELDS]).to_pylist():
                node = r.pop("node")
                start[node] = Node(**r)
            edge = batch.filter(pc.equal(kinds, "edge"))
            for held, name in zip(lists, ("a", "b", "distance")):
                held.append(edge.column(name).to_numpy())
        a, b, distance = (np.concatenate(held) if held else np.zeros(0) for held in lists)
        order = np.lexsort((b, a, distance))
        a, b, distance = (v[order].tolist() for v in (a, b, distance))
        roots, closed, left = grown(start, a, b, distance, least)
        out = chain(
            ({"kind": "node", "node": n.first, **{f: getattr(n, f) for f in FIELDS}} for n in roots.values()),
            (dict(zip(("kind", "cluster", "parent", "birth", "parted", "greatest"), ("closed", *c))) for c in closed),
            ({"kind": "left", "entity_id": p, "cluster": c} for p, c in left),
        )
        while part := list(islice(out, 10_000)):
            yield pa.RecordBatch.from_pylist(part, schema=arrow)

    rows = _filled(of_nodes).unionByName(_filled(of_edges))
    return (rows.coalesce(1) if labels is None else rows.repartition(tasks, "component")).mapInArrow(run, _STEP)


def flat_step(nodes: DataFrame, labels: DataFrame, distance: float, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As a step whose edges have all one distance, by grouping: (nodes, closed, left)."""
    lam = inverse(distance)
    met = nodes.join(labels.select("node", F.col("label").alias("component")), "node")
    big, small = F.col("cluster").isNotNull(), F.when(F.col("cluster").isNull(), F.col("size")).otherwise(0)
    mass = F.col("weight") - lam * F.col("size")
    best = F.when(~F.col("parted") | (mass >= F.col("below")), mass).otherwise(F.col("below"))
    whole = met.groupBy("component").agg(
        F.sum("size").alias("size"), F.min("first").alias("first"), F.count_if(big).alias("n_big"), F.max("cluster").alias("only"), F.sum("weight").alias("weight"), F.sum(F.when(big, best)).alias("best"),
        F.sum("below").alias("below"), F.sum(small).alias("n_small"), F.bool_or("parted").alias("was_parted"),
    )
    keeps, none = F.col("n_big") == 1, (F.col("n_big") == 0) & (F.col("size") < least)
    name = F.when(none, None).when(keeps, F.col("only")).otherwise(F.concat_ws(":", F.col("first").cast("string"), F.col("size").cast("string")))
    facts = whole.select(
        "component", "size", "first", name.alias("cluster"), F.when(none, 0.0).when(keeps, F.col("weight") + lam * F.col("n_small")).otherwise(lam * F.col("size")).alias("weight"),
        F.when(keeps, F.col("below")).otherwise(F.coalesce("best", F.lit(0.0))).alias("below"), F.when(keeps, F.col("was_parted")).otherwise(F.col("n_big") > 1).alias("parted"), keeps.alias("keeps"), none.alias("none"),
    )
    # members are gathered only where all of them are fewer than a cluster has
    few = met.join(facts.where("none").select("component"), "component").groupBy("component").agg(F.flatten(F.collect_list("members")).alias("members"))
    after = facts.join(few, "component", "left").select(F.col("first").alias("node"), "size", "first", F.coalesce("members", F.array().cast("array<long>")).alias("members"), "cluster", "weight", "below", "parted")
    ends = met.where(big).join(facts.where("not keeps and not none").select("component", F.col("cluster").alias("parent")), "component")
    closed = ends.select("cluster", "parent", F.lit(float(distance)).alias("birth"), "parted", (~F.col("parted") | (mass >= F.col("below"))).alias("greatest"))
    loose = met.where(~big).select("component", F.explode("members").alias("entity_id"))
    left = loose.join(facts.where("not none").select("component", "cluster"), "component").select("entity_id", "cluster")
    return after, closed, left


def condensed_tree(tree: DataFrame, least: int, task: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, points) of the condensed tree over the edges (a, b, distance) of a
    spanning tree: clusters (cluster, parent, birth, parted, greatest) with a null parent
    below the root, points (entity_id, cluster) without those that leave the root.

    ``greatest``: a cluster's own mass is not less than that of the best below it.
    """
    task, spark = task or TASK, tree.sparkSession
    tables = Tables(spark)
    ids = tree.select(F.col("a").alias("node")).union(tree.select("b")).distinct()
    start = {"size": F.lit(1).cast("long"), "first": F.col("node"), "members": F.array("node"), "cluster": F.lit(None).cast("string"), "weight": F.lit(0.0), "below": F.lit(0.0), "parted": F.lit(False)}
    if least <= 1:
        raise ValueError("a cluster has two members at least")
    nodes, edges = ids.withColumns(start), tree.select("a", "b", "distance")
    closed, left, m, level = [], [], edges.count(), 0
    while m:
        if m <= task:
            step = tables.keep(f"step{level}", condensed_step(nodes, edges, None, least, 1))
            nodes = step.where("kind = 'node'").select(*nodes.columns)
            closed.append(step.where("kind = 'closed'").select("cluster", "parent", "birth", "parted", "greatest"))
            left.append(step.where("kind = 'left'").select("entity_id", "cluster"))
            break
        share, flat = 1.0, False
        while True:  # the largest distance whose components fit
            limit = edges.agg(F.max("distance") if share == 1.0 else F.percentile_approx("distance", share, 10_000)).first()[0]
            lowest = edges.agg(F.min("distance")).first()[0]
            low = edges.where(F.col("distance") <= limit)
            labels = tables.keep("labels", components(low.select("a", "b")))
            most = low.join(labels.withColumnRenamed("node", "a"), "a").groupBy("label").count().agg(F.max("count")).first()[0]
            if most <= task or limit == lowest:
                flat = most > task
                break
            share = min(share / 2, 0.8 * share * task / most) if share > 1e-6 else 0.0
        if flat:
            after, ended, gone = flat_step(nodes, labels, limit, least)
            after, ended, gone = (tables.keep(f"{name}{level}", t) for name, t in (("after", after), ("closed", ended), ("left", gone)))
        else:
            step = tables.keep(f"step{level}", condensed_step(nodes, low, labels, least, max(1, -(-low.count() // task))))
            after, ended, gone = (step.where(F.col("kind") == kind) for kind in ("node", "closed", "left"))
        closed.append(ended.select("cluster", "parent", "birth", "parted", "greatest"))
        left.append(gone.select("entity_id", "cluster"))
        # a component goes on as its smallest node; nodes that no edge reached stay
        moved = labels.select("node", F.col("label").alias("to"))
        rest = nodes.join(moved, "node", "left_anti").select(*nodes.columns)
        nodes = tables.keep("nodes", rest.unionByName(after.select(*nodes.columns)))
        above = edges.where(F.col("distance") > limit)
        for side in ("a", "b"):
            above = above.join(moved.select(F.col("node").alias(side), "to"), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        edges = tables.keep("edges", above.select("a", "b", "distance"))
        m, level = edges.count(), level + 1
    roots = nodes.where("cluster is not null").select(F.col("cluster").alias("parent"))
    clusters, points = (reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema) for found, schema in ((closed, CLOSED), (left, "entity_id long, cluster string")))
    root = roots.first()  # a spanning tree has one
    root = F.lit(root["parent"] if root else None).cast("string")
    clusters = cut(clusters.select("cluster", F.when(~F.col("parent").eqNullSafe(root), F.col("parent")).alias("parent"), "birth", "parted", "greatest"))
    points = cut(points.where(~F.col("cluster").eqNullSafe(root)).select("entity_id", "cluster"))
    tables.drop_all()
    return clusters, points


SETTING = ["method", "epsilon"]


def highest(clusters: DataFrame, marked: Column) -> DataFrame:
    """(setting, cluster, top): the highest marked one of a cluster and those above it.

    Pointers double their reach with every round.
    """
    tables = Tables(clusters.sparkSession)
    state = tables.keep("state", clusters.select(*SETTING, "cluster", F.col("parent").alias("up"), F.when(marked, F.col("cluster")).alias("top")))
    while not state.where("up is not null").isEmpty():
        over = state.select(*SETTING, F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        state = tables.keep("state", state.join(over, [*SETTING, "up"], "left").select(*SETTING, "cluster", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top")))
    out = cut(state.where("top is not null").select(*SETTING, "cluster", "top"))
    tables.drop_all()
    return out


def lifted(clusters: DataFrame) -> DataFrame:
    """(setting, cluster, to): the first of a cluster and those above it that is born at
    the setting's epsilon or farther, or else the one below the root."""
    tables = Tables(clusters.sparkSession)
    stays = (F.col("birth") >= F.col("epsilon")) | F.col("parent").isNull()
    state = tables.keep("state", clusters.select(*SETTING, "cluster", F.when(stays, F.col("cluster")).otherwise(F.col("parent")).alias("to")))
    done = False
    while not done:
        over = state.select(*SETTING, F.col("cluster").alias("to"), F.col("to").alias("_to"))
        further = state.join(over, [*SETTING, "to"]).select(*SETTING, "cluster", F.col("_to").alias("to"), (F.col("to") != F.col("_to")).alias("moved"))
        state = tables.keep("state", further)
        done = state.where("moved").isEmpty()
    out = cut(state.select(*SETTING, "cluster", "to"))
    tables.drop_all()
    return out


def risen(parent: dict, birth: dict, chosen: set, epsilon: float) -> set:
    """What the chosen clusters give way to; a way up is gone once, however many share it."""
    to: dict = {}
    for c in chosen:
        way = []
        while c not in to and birth[c] < epsilon and parent[c] is not None:
            way.append(c)
            c = parent[c]
        top = to.setdefault(c, c)
        for w in way:
            to[w] = top
    return {to[c] for c in chosen}


def resolved(clusters: DataFrame, own: Column) -> DataFrame:
    """(setting, cluster, top): the final cluster that each is in, for so few clusters
    that a task holds those of a setting."""
    arrow = pa.schema([("method", pa.string()), ("epsilon", pa.float64()), ("cluster", pa.string()), ("top", pa.string())])

    def tops(parent: dict, marked: set) -> dict:
        out: dict = {}
        for c in parent:
            way = [c]
            while way[-1] not in out and parent[way[-1]] is not None:
                way.append(parent[way[-1]])
            top = out.get(way[-1])
            for w in reversed(way):
                top = top if top is not None else w if w in marked else None
                out[w] = top
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault((r["method"], r["epsilon"]), []).append(r)
        for (method, epsilon), rows in held.items():
            parent = {r["cluster"]: r["parent"] for r in rows}
            birth = {r["cluster"]: r["birth"] for r in rows}
            chosen = {t for t in tops(parent, {r["cluster"] for r in rows if r["own"]}).values() if t is not None}
            found = [(c, t) for c, t in tops(parent, risen(parent, birth, chosen, epsilon)).items() if t is not None]
            for at in range(0, len(found), 10_000):
                part = found[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([method] * len(part)), pa.array([epsilon] * len(part), pa.float64()), pa.array([c for c, _ in part]), pa.array([t for _, t in part])], schema=arrow)

    rows = clusters.select(*SETTING, "cluster", "parent", "birth", own.alias("own"))
    return rows.repartition(*SETTING).mapInArrow(run, "method string, epsilon double, cluster string, top string")


def selected(clusters: DataFrame, points: DataFrame, settings: list[tuple[str, float]], task: int | None = None) -> DataFrame:
    """(method, epsilon, entity_id, label) of the points of selected clusters for every
    setting; labels are numbered by first members."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(e)).alias("epsilon")) for m, e in settings]))
    tried = clusters.withColumn("_s", each).select("_s.*", *clusters.columns)
    own = F.when(F.col("method") == "leaf", ~F.col("parted")).otherwise(F.col("greatest"))
    if clusters.count() <= (task or TASK):
        tops = resolved(tried, own)
    else:
        tried = cut(tried)
        chosen = highest(tried, own).select(*SETTING, F.col("top").alias("cluster")).distinct()
        final = lifted(tried).join(chosen, [*SETTING, "cluster"]).select(*SETTING, F.col("to").alias("cluster")).distinct().withColumn("final", F.lit(True))
        tops = highest(tried.join(final, [*SETTING, "cluster"], "left"), F.coalesce("final", F.lit(False)))
    found = cut(points.join(tops, "cluster").select(*SETTING, "entity_id", "top"))
    ranks = numbered(found.groupBy(*SETTING, "top").agg(F.min("entity_id").alias("first")), *SETTING, "first")
    start = ranks.groupBy(*SETTING).agg(F.min("position").alias("start"))
    labels = ranks.join(F.broadcast(start), SETTING).select(*SETTING, "top", (F.col("position") - F.col("start")).alias("label"))
    return found.join(labels, [*SETTING, "top"]).select(*SETTING, "entity_id", "label")


def hdbscan_sweep(vectors: DataFrame, settings: list[tuple[str, float, int]], metric: str = "cosine") -> DataFrame:
    """(method, epsilon, least, entity_id, label) for every setting (method, epsilon, least).

    All settings share one spanning tree, and those of one size one condensed tree.
    """
    edges, out = spanning_tree(vectors, metric), []
    for least in dict.fromkeys(n for _, _, n in settings):  # numbers given by the caller
        own = [(m, float(e)) for m, e, n in settings if n == least]
        labels = selected(*condensed_tree(edges, least), own)
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(e).alias("epsilon")) for m, e in own]))
        every = vectors.select("entity_id", each.alias("_s")).select("_s.*", F.lit(least).alias("least"), "entity_id")
        out.append(every.join(labels, [*SETTING, "entity_id"], "left").select(*SETTING, "least", "entity_id", F.coalesce("label", F.lit(-1)).cast("long").alias("label")))
    return reduce(DataFrame.unionByName, out)


def hdbscan(vectors: DataFrame, epsilon: float, least: int = 2, metric: str = "cosine", method: str = "eom") -> DataFrame:
    """(entity_id, label): labels from 0 in the order of first members, -1 for noise."""
    return hdbscan_sweep(vectors, [(method, epsilon, least)], metric).select("entity_id", "label")
