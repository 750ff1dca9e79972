"""Density clustering of vectors and the choice of its radius.

With two points to a core, density clusters are the connected components of the graph of
pairs within the radius: a point with one neighbour is a core, so that there are no
border points, and points without neighbours are noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.config import SETTINGS, Settings
from certloom.functions.vectors import nonzero
from certloom.operators import pair_stats, pairs
from certloom.operators.graph import components
from certloom.operators.hierarchy import TASK, least_edges
from certloom.operators.lineage import cut
from certloom.operators.order import numbered


def k_distances(vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(position, distance): distances to the k-th other vector, ascending."""
    kth = pairs.nearest(vectors, k, metric).where(F.col("rank") == k).select("entity_id", "distance")
    return numbered(kth, "distance", "entity_id").select("position", "distance")


def raw_eps(curve: DataFrame) -> DataFrame:
    """(position, eps) where the curve of k-distances bends most, the first such place."""
    at = lambda n: curve.select((F.col("position") - n).alias("position"), F.col("distance").alias(f"d{n}"))
    bend = at(0).join(at(1), "position").join(at(2), "position").select("position", (F.col("d2") - 2 * F.col("d1") + F.col("d0")).alias("bend"))
    knee = bend.agg(F.max_by(F.col("position") + 1, F.struct(F.round("bend", 12), -F.col("position"))).alias("position"))
    return curve.join(F.broadcast(knee), "position").select("position", F.col("distance").alias("eps"))


def estimate_eps(vectors: DataFrame, k: int | None = None, metric: str = "cosine", s: Settings = SETTINGS) -> float:
    """The radius at the bend of the k-distances, within the allowed limits.

    With too few vectors for a curve it is the default.
    """
    k = k or s.min_samples
    if vectors.limit(max(k + 1, 3)).count() < max(k + 1, 3):
        return s.dbscan_eps
    found = raw_eps(k_distances(vectors, k, metric)).first()
    return s.dbscan_eps if found is None else max(s.eps_floor, min(s.eps_ceiling, found["eps"]))


def dbscan(vectors: DataFrame, eps: float, metric: str = "cosine") -> DataFrame:
    """(entity_id, label): labels from 0 in the order of first members, -1 for noise."""
    links = pairs.distances(vectors, metric, eps, joining=True).select("a", "b")
    found = components(links)
    ranks = numbered(found.select(F.col("label").alias("first")).distinct(), "first", name="rank")
    labels = found.join(ranks, found["label"] == ranks["first"]).select(F.col("node").alias("entity_id"), "rank")
    return vectors.select("entity_id").join(labels, "entity_id", "left").select("entity_id", F.coalesce(F.col("rank"), F.lit(-1)).cast("long").alias("label"))


def cluster(vectors: DataFrame, eps: float | None = None, skip_zero: bool = False, s: Settings = SETTINGS) -> tuple[DataFrame, dict]:
    """Labels of the vectors, and the radius that was the default and was used.

    Without ``eps`` it is estimated from ten vectors on, else it is the default.
    """
    if skip_zero:
        vectors = vectors.where(nonzero(F.col("vector")))
    if eps is None:
        eps = estimate_eps(vectors, s=s) if vectors.limit(10).count() == 10 else s.dbscan_eps
    return dbscan(vectors, eps), {"eps_default": s.dbscan_eps, "eps_used": eps, "min_samples": s.min_samples}


def group_ids(labelled: DataFrame) -> DataFrame:
    """With the group's name (the label, or noise and the id) and whether it is noise."""
    noise = F.col("label") < 0
    return labelled.select("*", F.when(noise, F.concat(F.lit("noise_"), F.col("entity_id").cast("string"))).otherwise(F.col("label").cast("string")).alias("group_id"), noise.alias("is_noise"))


def groups(labelled: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(group_id, is_noise, items, count, is_abnormal) of every group."""
    grouped = group_ids(labelled).groupBy("group_id", "is_noise").agg(F.array_sort(F.collect_list("entity_id")).alias("items"), F.count(F.lit(1)).alias("count"))
    return grouped.withColumn("is_abnormal", ~F.col("is_noise") & (F.col("count") >= s.abnormal_min_size))


def group_order(grouped: DataFrame) -> DataFrame:
    """Groups for display: noise last, abnormal ones first, larger ones first."""
    return grouped.orderBy("is_noise", F.desc("is_abnormal"), F.desc("count"), "group_id")


def histogram(distances: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, low, high, count) over equal widths; the largest value is in the last bin."""
    span = distances.agg(F.min("distance").alias("x"), F.max("distance").alias("y")).first()
    x, y = span["x"], span["y"]
    if x is None:
        return distances.sparkSession.createDataFrame([], "bin int, low double, high double, count long")
    width = (y - x) / bins or 1.0
    place = F.least(F.floor((F.col("distance") - x) / width), F.lit(bins - 1)).cast("int")
    counted = distances.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = distances.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (x + F.col("bin") * width).alias("low"), (x + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def eps_sweep(vectors: DataFrame, radii: list[float], metric: str = "cosine") -> DataFrame:
    """(eps, n_clusters, n_noise) of several radii; distances are measured once.

    A minimum spanning forest within the greatest radius has for each radius a tree of every
    cluster, and of each vector an edge to its nearest. So the vectors with an edge within a radius
    are those in clusters, and there is one cluster more for each edge that they lack.
    """
    links = cut(pairs.distances(vectors.select("entity_id", "vector"), metric, max(radii), shortest=True))
    tree = cut(whole_forest(links))
    nearest = tree.select(F.explode(F.array("a", "b")).alias("id"), "distance").groupBy("id").agg(F.min("distance").alias("distance"))
    within = [F.count_if(F.col("distance") <= eps) for eps in radii]
    facts = nearest.agg(F.array(*within).alias("held")).join(F.broadcast(tree.agg(F.array(*within).alias("edges"))), F.lit(True)).join(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("n"))), F.lit(True))
    row = [F.struct(F.lit(eps).alias("eps"), (F.col("held")[i] - F.col("edges")[i]).alias("n_clusters"), (F.col("n") - F.col("held")[i]).alias("n_noise")) for i, eps in enumerate(radii)]
    return facts.select(F.inline(F.array(*row)))


def whole_forest(links: DataFrame) -> DataFrame:
    """(a, b, distance) of a minimum spanning forest of the edges: by one task if they are few, else
    in rounds of shortest edges out of each component."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [tuple(f[c].to_numpy() for c in ("a", "b", "distance")) for f in frames if len(f)]
        yield from pairs.handed(found, True, True)

    if links.limit(TASK + 1).count() > TASK:
        return least_edges(links)
    return links.coalesce(1).mapInPandas(run, "a long, b long, distance double")


def members(labelled: DataFrame, names: DataFrame | None = None, s: Settings = SETTINGS) -> DataFrame:
    """(entity_id, group_id, is_noise, count, is_abnormal, filename) of every item.

    The membership is a table, so that no group is gathered; ``names``: entity_id,
    filename, null where there is none.
    """
    placed = group_ids(labelled)
    counted = placed.groupBy("group_id").agg(F.count(F.lit(1)).alias("count"))
    out = placed.join(counted, "group_id").withColumn("is_abnormal", ~F.col("is_noise") & (F.col("count") >= s.abnormal_min_size))
    if names is not None:
        out = out.join(names.select("entity_id", "filename"), "entity_id", "left")
    return out


def visible(grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups that are no noise, and how many are (n_hidden)."""
    return grouped.where("not is_noise"), grouped.agg(F.count_if("is_noise").alias("n_hidden"))


def eps_candidates(vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """(eps, n_clusters, n_noise) of 13 radii from 0.03 to 0.15.

    ValueError for two vectors or fewer.
    """
    if vectors.limit(3).count() <= 2:
        raise ValueError("too few vectors to describe a clustering")
    return eps_sweep(vectors, [round(0.03 + 0.01 * i, 2) for i in range(13)], metric)


def cluster_debug(vectors: DataFrame, metric: str = "cosine", s: Settings = SETTINGS) -> dict:
    """What helps to choose a radius: the k-distance curve, a histogram of 20 bins, the
    clusters of 13 radii from 0.03 to 0.15, the suggested radius and the vectors' number.

    The first three are DataFrames; k is 4, or one less than the vectors if they are few.
    ValueError for two vectors or fewer. Templates are measured with ``metric`` euclidean.
    """
    candidates, n = eps_candidates(vectors, metric), vectors.count()
    k = min(4, n - 1)
    return {
        "k_distance_curve": k_distances(vectors, k, metric),
        "distance_histogram": pair_stats.Distances(vectors, metric).histogram(20),
        "eps_candidates": candidates,
        "suggested_eps": round(estimate_eps(vectors, k, metric, s), 4),
        "sample_count": n,
    }
