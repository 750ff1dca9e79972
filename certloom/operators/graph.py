"""Connected components of an edge list.

Each round first contracts edges in tiles: a task turns its tile of at most about TILE
edges into stars around the smallest node that they connect. Between tiles large and
small stars alternate: nodes hang their neighbours on the smallest one, by groupings and
joins on a node. Few rounds do even for chains; edges that fit one tile need none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.operators.lineage import Tables, cut

#: Edges that a task holds while it contracts them (a few bytes each and their nodes).
TILE = 200_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that the edges connect, but for the roots themselves;
    the root is the smallest node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(len(nodes)))
    for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist()):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
    for i in range(len(up)):  # a parent comes before its children
        up[i] = up[up[i]]
    roots = nodes[np.array(up, dtype=np.int64)] if len(nodes) else nodes
    moved = roots != nodes
    return nodes[moved], roots[moved]


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges (u, v) as stars."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            u, v = stars(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    return edges.mapInArrow(run, "u long, v long")


def in_tiles(edges: DataFrame, tiles: int) -> DataFrame:
    """The edges in so many tiles of about equal size: they are dealt anew, as joining
    partitions would leave a large one as it is."""
    return edges.coalesce(1) if tiles == 1 else edges.repartition(tiles)


def components(edges: DataFrame, tile: int = TILE) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node reachable.

    Edges are held as (u, v) with u > v; null ends and loops are left out.
    """
    tables = Tables(edges.sparkSession)
    long = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"), (F.col("a") < F.col("b")).alias("_up"), (F.col("a") > F.col("b")).alias("_down"))
    edges = tables.keep("edges", long.where("_up or _down").select("u", "v").distinct())
    before = None
    while True:
        n = edges.count()
        tiles = max(1, math.ceil(n / tile))
        small = _contracted(in_tiles(edges, tiles))
        if tiles == 1:
            break
        hung = tables.keep("hung", small.distinct())
        both = hung.union(hung.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tables.keep("edges", moved.union(small.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            small = edges
            break
        before = state
    done = cut(small)
    tables.drop_all()
    hung = done.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return hung.union(hung.select(F.col("label"), F.col("label")).distinct())
