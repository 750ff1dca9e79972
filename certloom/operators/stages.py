"""Stages after a first clustering of templates: layout, merging, noise.

All take and return (entity_id, vector, asymmetry, label), noise as -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.config import SETTINGS, Settings
from certloom.operators import pair_stats, pairs
from certloom.operators.graph import components
from certloom.operators.lineage import cut
from certloom.operators.order import numbered


def relabelled(items: DataFrame, changes: DataFrame, key: str, new: str) -> DataFrame:
    """``items`` with the labels that ``changes`` (key, new) has for some of them."""
    return items.join(changes.select(F.col(key).alias("_key"), F.col(new).alias("_new")), items[key] == F.col("_key"), "left").withColumn("label", F.coalesce("_new", "label")).drop("_key", "_new")


def layout_split(items: DataFrame, threshold: float | None = None, s: Settings = SETTINGS) -> DataFrame:
    """Clusters of single and folded pages part: the folded side gets a label of its own.

    A cluster parts if each side has at least min_samples members; new labels follow the
    largest one in the order of the old ones.
    """
    limit = s.layout_threshold if threshold is None else threshold
    low = F.col("asymmetry") < limit
    sides = items.where("label >= 0").groupBy("label").agg(F.count_if(low).alias("n_low"), F.count_if(~low).alias("n_high"))
    parting = sides.where((F.col("n_low") >= s.min_samples) & (F.col("n_high") >= s.min_samples)).select("label")
    first = (items.agg(F.max("label")).first()[0] or 0) + 1
    new = numbered(parting, "label", name="rank").select(F.col("label").alias("_old"), (F.col("rank") + max(first, 0)).alias("_new"))
    return items.join(new, (items["label"] == F.col("_old")) & ~low, "left").withColumn("label", F.coalesce("_new", "label")).drop("_old", "_new")


def mean_vector(grouped: DataFrame, *keys: str) -> DataFrame:
    """(keys, vector): the mean of the vectors of each group, not brought to unit length."""
    by_place = grouped.select(*keys, F.posexplode("vector").alias("at", "x")).groupBy(*keys, "at").agg(F.avg("x").alias("x"))
    return by_place.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select(*keys, F.transform("v", lambda p: p["x"]).alias("vector"))


def layout(asymmetry: Column, limit: float) -> Column:
    return F.when(asymmetry >= limit, "folded").otherwise("single")


def centroids(items: DataFrame, threshold: float | None = None, s: Settings = SETTINGS) -> DataFrame:
    """(label, vector, asymmetry, layout, size) of every cluster."""
    limit = s.layout_threshold if threshold is None else threshold
    members = items.where("label >= 0")
    facts = members.groupBy("label").agg(F.avg("asymmetry").alias("asymmetry"), F.count(F.lit(1)).alias("size"))
    return mean_vector(members, "label").join(facts, "label").withColumn("layout", layout(F.col("asymmetry"), limit))


def merge(items: DataFrame, merge_threshold: float | None = None, threshold: float | None = None, s: Settings = SETTINGS) -> DataFrame:
    """Clusters of one layout whose centroids are near become one, also by chains.

    Labels are numbered anew in the order of the clusters' first members.
    """
    near = s.merge_threshold if merge_threshold is None else merge_threshold
    centres = cut(centroids(items, threshold, s))
    links = pairs.distances(centres.select(F.col("label").alias("entity_id"), "vector"), "euclidean", near, below=True).select("a", "b")
    kind = centres.select("label", "layout")
    same = links.join(kind.select(F.col("label").alias("a"), F.col("layout").alias("x")), "a").join(kind.select(F.col("label").alias("b"), F.col("layout").alias("y")), "b").where("x = y").select("a", "b")
    roots = components(same)
    rooted = items.where("label >= 0").join(roots, items["label"] == roots["node"], "left").select("entity_id", F.coalesce(roots["label"], items["label"]).alias("root"))
    return relabelled(items, first_appearance(rooted, "root"), "entity_id", "rank")


def first_appearance(rooted: DataFrame, key: str, start: int = 0) -> DataFrame:
    """(entity_id, rank): groups numbered by their smallest id, from ``start``."""
    firsts = rooted.groupBy(key).agg(F.min("entity_id").alias("first"))
    ranks = numbered(firsts, "first", name="rank").select(key, (F.col("rank") + start).alias("rank"))
    return rooted.join(ranks, key).select("entity_id", "rank")


def recover_noise(items: DataFrame, limit: float | None = None, s: Settings = SETTINGS) -> DataFrame:
    """Noise joins the cluster with the nearest centroid, if it is near enough.

    Centroids are those before anything joins; ties go to the smaller label.
    """
    most = s.merge_threshold * s.noise_recovery_factor if limit is None else limit
    centres = mean_vector(items.where("label >= 0"), "label").withColumnRenamed("label", "target")
    best = pairs.nearest_of(items.where("label < 0").select("entity_id", "vector"), centres).where(F.col("distance") < most)
    return relabelled(items, best, "entity_id", "target")


def pair_noise(items: DataFrame, threshold: float | None = None, s: Settings = SETTINGS) -> DataFrame:
    """Noise within the threshold of other noise forms new clusters, also by chains."""
    near = s.noise_pair_threshold if threshold is None else threshold
    links = pairs.distances(items.where("label < 0").select("entity_id", "vector"), "euclidean", near, below=True, joining=True).select("a", "b")
    found = components(links).select(F.col("node").alias("entity_id"), F.col("label").alias("root"))
    largest = items.agg(F.max("label")).first()[0]
    return relabelled(items, first_appearance(found, "root", max(-1 if largest is None else largest, -1) + 1), "entity_id", "rank")


def noise_diagnostics(items: DataFrame) -> DataFrame:
    """One row on the distances between noise: count, smallest, quartile, median, ten least.

    Quartile and median are the values at a place of the sorted distances.
    """
    noise = items.where("label < 0").select("entity_id", "vector")
    measured = pair_stats.Distances(noise, "euclidean")
    n, least, _, _ = measured.extent()
    at = measured.at([n // 4, n // 2])
    top = [r["distance"] for r in measured.least(10).collect()]
    row = noise.agg(F.count(F.lit(1)).alias("count"))
    value = lambda x: F.round(F.lit(x).cast("double"), 4)
    return row.select(
        "count", value(least).alias("min_dist"), value(at.get(n // 4)).alias("p25_dist"), value(at.get(n // 2)).alias("median_dist"), F.array(*map(value, top)).cast("array<double>").alias("top10_smallest")
    )


def template_pipeline(items: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """All stages after the first clustering, in order."""
    for stage in (layout_split, merge, recover_noise, pair_noise):
        items = cut(stage(items, s=s))
    return items
