"""Clusters by complete linkage: all members of one are within a distance of each other.

Two clusters can only meet if every pair between them is within the limit. No pairs are
kept: each round looks for the nearest cluster of those that changed, or whose nearest
changed, by multiplying blocks of vectors, and only the nearest of each cluster goes on.
All clusters that are each other's nearest (in the order of distance and ids) merge. As
the linkage is reducible, merging them together gives what merging the nearest two one
after the other gives; and as distances only grow, what was nearest stays nearest until one
of both merges, and a cluster with none within the limit is done and leaves. What is left
of at most FINISHED vectors is finished by one task.

A cluster's members share a block, if they are no more than a block has; a larger one is
dealt in parts, whose pairs are counted, and it meets another one if no pair lacks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.operators import pairs
from certloom.operators.graph import components
from certloom.operators.lineage import Tables
from certloom.operators.order import numbered

#: Vectors that a task merges by itself, vectors of a block on average, pairs measured and rows held at a time.
FINISHED, BLOCK, MEASURED, HELD = 4_096, 1_024, 16_384, 200_000
#: Groups of blocks, and blocks of one at most: a vector is sent once for each group in a round, so they are few.
GROUPS, MOST_BLOCKS = 8, 64
FOUND = "cluster long, size long, other long, distance double, n long, pairs long"


def _units(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(np.isfinite(u).all(axis=1, keepdims=True), u, 0.0)


def _measured(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows from rows. They depend on the two rows alone and not on their order,
    as a product of blocks does not, so that two clusters agree on their distance in all rounds."""
    if metric != "cosine":
        apart = x - y
        return np.sqrt((apart * apart).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        d = 1 - (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    return np.where(np.isfinite(d), d, 1.0)


def close_pairs(x: np.ndarray, y: np.ndarray, limit: float, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of all rows nearer than the limit. A product of both, with room for
    what it rounds, says which pairs are measured."""
    if metric == "cosine":
        at = np.flatnonzero(_units(x) @ _units(y).T >= 1 - limit - 1e-12)
    else:
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        left = np.column_stack([x, (limit * limit - xx) / 2, np.ones(len(x))])
        right = np.column_stack([y, np.ones(len(y)), -yy / 2])
        at = np.flatnonzero(left @ right.T >= -1e-12 * (limit * limit + xx.max() + yy.max()))
    i, j = np.divmod(at, len(y))
    d = np.empty(len(at))
    for k in range(0, len(at), MEASURED):
        d[k : k + MEASURED] = _measured(x[i[k : k + MEASURED]], y[j[k : k + MEASURED]], metric)
    near = d < limit
    return i[near], j[near], d[near]


def met(a: tuple, b: tuple, limit: float, metric: str) -> pd.DataFrame:
    """(cluster, size, other, size_other, distance, n): clusters of two blocks (cluster of each
    row, vectors, size of its cluster), no pair of which that is there lacks."""
    (u, at, n_u), (v, to, n_v) = (np.unique(ids, return_index=True, return_counts=True) for ids, _, _ in (a, b))
    i, j, d = close_pairs(a[1], b[1], limit, metric)
    x, y = np.searchsorted(u, a[0][i]), np.searchsorted(v, b[0][j])
    other = u[x] != v[y]
    key, d = (x * len(v) + y)[other], d[other]
    order = np.argsort(key, kind="stable")
    key, first, n = np.unique(key[order], return_index=True, return_counts=True)
    greatest = np.maximum.reduceat(d[order], first) if len(first) else d
    x, y = np.divmod(key, len(v))
    full = n == n_u[x] * n_v[y]
    x, y, greatest, n = x[full], y[full], greatest[full], n[full]
    return pd.DataFrame({"cluster": u[x], "size": a[2][at[x]], "other": v[y], "size_other": b[2][to[y]], "distance": greatest, "n": n})


def _nearest(found: list[pd.DataFrame]) -> pd.DataFrame:
    """Of whole clusters only the nearest of each, ties to the smaller one; parts as they are."""
    rows = pd.concat(found, ignore_index=True)
    whole = rows["n"].to_numpy() == rows["pairs"].to_numpy()
    nearest = rows[whole].sort_values(["cluster", "distance", "other"]).drop_duplicates("cluster")
    return pd.concat([nearest, rows[~whole]], ignore_index=True)


def nearest_clusters(members: DataFrame, limit: float, metric: str) -> DataFrame:
    """(cluster, size, other, distance) of the nearest cluster within the limit of each that is
    ``active``. ``members``: item, cluster, size, active, vector.

    Blocks of the active come first; their groups meet each other and those of the rest.
    """
    counts = {r["active"]: r["count"] for r in members.groupBy("active").count().collect()}
    n, rest = (math.ceil(counts.get(k, 0) / BLOCK) for k in (True, False))
    size = pairs.group_size(n + rest, GROUPS, MOST_BLOCKS)
    start = math.ceil(n / size) * size  # groups have active blocks only, or none
    part = F.pmod(F.xxhash64("item", F.lit(3)), F.ceil(F.col("size") / BLOCK))
    of_active, of_rest = F.pmod(F.xxhash64("cluster", part), F.lit(max(1, n))), start + F.pmod(F.xxhash64("cluster", part), F.lit(max(1, rest)))
    row = F.struct(F.col("cluster").alias("entity_id"), "vector", "size").alias("row")
    blocks = members.select(F.when(F.col("active"), of_active).otherwise(of_rest).cast("long").alias("number"), row).groupBy("number")
    grouped = pairs.packed(blocks.agg(F.sort_array(F.collect_list("row")).alias("rows")), "number", "size").withColumn("group", F.expr(f"number div {size}"))
    first, groups = start // size, (start + rest + size - 1) // size
    meeting = members.sparkSession.range(first).select(F.col("id").alias("x"), F.explode(F.sequence(F.col("id"), F.lit(groups - 1).cast("long"))).alias("y"))
    held_most = HELD

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tiles in pairs.block_tiles(frame, "size"):
                found, held = [], 0
                for p, q, a, b in tiles:
                    rows = met(a, b, limit, metric)
                    rows["pairs"] = rows["size"] * rows["size_other"]
                    found.append(rows)
                    if q != p and q < start:
                        found.append(rows.rename(columns={"cluster": "other", "other": "cluster", "size": "size_other", "size_other": "size"}))
                    held += 2 * len(rows)
                    if held > held_most:
                        found = [_nearest(found)]
                        held = len(found[0])
                        if held > held_most // 2:
                            yield found.pop()[["cluster", "size", "other", "distance", "n", "pairs"]]
                            held = 0
                if found:
                    yield _nearest(found)[["cluster", "size", "other", "distance", "n", "pairs"]]

    found = pairs.groups_met(grouped, meeting, first * groups - first * (first - 1) // 2).mapInPandas(run, FOUND)
    # dealt by the cluster once, for both groupings
    full = found.repartition("cluster").groupBy("cluster", "other").agg(F.max("size").alias("size"), F.max("distance").alias("distance"), F.sum("n").alias("n"), F.max("pairs").alias("pairs")).where("n = pairs")
    return full.groupBy("cluster").agg(F.max("size").alias("size"), F.min(F.struct("distance", "other")).alias("m")).select("cluster", "size", "m.other", "m.distance")


def merged_in_one(frame: pd.DataFrame, limit: float, metric: str) -> pd.DataFrame:
    """(a, b) of all merges among so few vectors that a task holds their distances."""
    ids, of = np.unique(frame["cluster"].to_numpy(), return_inverse=True)
    x = np.array([np.asarray(v, dtype=np.float64) for v in frame["vector"]])
    size = np.bincount(of)
    d, n = np.zeros((len(ids), len(ids))), np.zeros((len(ids), len(ids)), dtype=np.int32)
    for at in range(0, len(x), 512):
        i, j, length = close_pairs(x[at : at + 512], x, limit, metric)
        np.maximum.at(d, (of[i + at], of[j]), length)
        np.add.at(n, (of[i + at], of[j]), 1)
    d[(n != np.outer(size, size))] = np.inf
    del n
    np.fill_diagonal(d, np.inf)
    near = d.argmin(axis=1)  # the smaller one of equally near ones
    merges = []
    while True:
        some = np.flatnonzero(np.isfinite(d[np.arange(len(ids)), near]))
        mutual = some[(near[near[some]] == some) & (some < near[some])]
        if not len(mutual):
            return pd.DataFrame(merges, columns=["a", "b"], dtype="int64")
        gone = near[mutual]
        merges += zip(ids[mutual].tolist(), ids[gone].tolist())
        d[mutual] = np.maximum(d[mutual], d[gone])
        d[:, mutual] = np.maximum(d[:, mutual], d[:, gone])
        d[gone], d[:, gone], d[mutual, mutual] = np.inf, np.inf, np.inf
        changed = np.zeros(len(ids), dtype=bool)
        changed[mutual], changed[gone] = True, True
        again = np.flatnonzero(changed | changed[near])
        near[again] = d[again].argmin(axis=1)


def merges_of(items: DataFrame, limit: float, metric: str, tables: Tables) -> list[DataFrame]:
    """Tables of the merges (a, b) of each round, a the smaller one, which goes on."""
    live = tables.keep("live", items.select("item", F.col("item").alias("cluster"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("active"), "vector"))
    near, merged = None, []
    while True:
        if live.count() <= FINISHED:

            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                if parts := [f for f in frames if len(f)]:
                    yield merged_in_one(pd.concat(parts, ignore_index=True), limit, metric)

            return [*merged, tables.keep("last", live.select("cluster", "vector").coalesce(1).mapInPandas(run, "a long, b long"))]
        found = nearest_clusters(live, limit, metric)
        near = tables.keep("near", found if near is None else near.unionByName(found))
        mutual = near.groupBy(F.least("cluster", "other").alias("a"), F.greatest("cluster", "other").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        merges = tables.keep(f"merges{len(merged)}", mutual.where("n = 2").select("a", "b", "size"))
        merged.append(merges.select("a", "b"))
        into = merges.select(F.explode(F.array("a", "b")).alias("from"), F.col("a").alias("to"), F.col("size").alias("whole"))
        own, others = into.withColumnRenamed("from", "cluster"), into.select(F.col("from").alias("other"), F.lit(True).alias("moved"))
        state = near.join(own, "cluster", "left").join(others, "other", "left")
        turn = tables.keep("turn", state.select("cluster", F.coalesce("to", "cluster").alias("to"), F.coalesce("whole", "size").alias("size"), "other", "distance", F.coalesce("moved", F.col("to").isNotNull()).alias("active")))
        # clusters without any within the limit have no row and leave
        live = tables.keep("live", live.select("item", "cluster", "vector").join(turn, "cluster").select("item", F.col("to").alias("cluster"), "size", "active", "vector"))
        near = turn.where("not active").select("cluster", "size", "other", "distance")


def complete_linkage(vectors: DataFrame, limit: float, metric: str = "cosine") -> DataFrame:
    """(entity_id, label): clusters whose members are all nearer than ``limit`` to each other,
    numbered from 0 by their smallest ids. Every vector is in one, if alone.

    Ties go to the smaller ids. Equal vectors are one item: they merge before all others.
    Nothing merges at a limit of 0.
    """
    tables = Tables(vectors.sparkSession)
    rows = vectors.select("entity_id", "vector")
    named = tables.keep("items", rows.groupBy("vector").agg(F.min("entity_id").alias("item")) if limit > 0 else rows.withColumnRenamed("entity_id", "item"))
    merged = merges_of(named, limit, metric, tables)
    links = merged[0]
    for more in merged[1:]:
        links = links.unionByName(more)
    roots = components(links).select(F.col("node").alias("item"), "label")
    placed = named.join(roots, "item", "left").select("item", "vector", F.coalesce("label", "item").alias("root"))
    # a vector is found again by its own value where equal ones are one item
    members = rows.join(placed, "vector") if limit > 0 else rows.join(placed.drop("vector"), rows["entity_id"] == placed["item"])
    ranks = numbered(placed.select("root").distinct(), "root", name="label")
    return members.select("entity_id", "root").join(ranks, "root").select("entity_id", "label")
