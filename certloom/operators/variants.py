"""Other orders and settings of the template stages: sweeps, fused colours, colour groups first.

Items are (entity_id, vector, ...), labels as in ``stages``: noise is -1.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.functions.vectors import fused, normalized
from certloom.operators import hierarchy, stages
from certloom.operators.lineage import cut
from certloom.operators.order import numbered

ANY_LAYOUT = float("-inf")
"""Threshold with which all clusters are of one layout."""


def sweep(vectors: DataFrame, radii: list[float], methods: tuple[str, ...] = ("eom", "leaf"), sizes: tuple[int, ...] = (2,), expected: DataFrame | None = None, metric: str = "euclidean") -> DataFrame:
    """(method, epsilon, least, n_clusters, n_noise[, score]) of hierarchical clusterings.

    ``expected``: (entity_id, group). A group of one counts if its item is noise or no
    other expected item has its label, a larger one if its items share a label that no
    other expected item has; ``score`` is how many groups count.
    """
    keys = ["method", "epsilon", "least"]
    found = cut(hierarchy.hdbscan_sweep(vectors, [(m, e, n) for e in radii for m in methods for n in sizes], metric))
    out = found.groupBy(*keys).agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"), F.count_if(F.col("label") < 0).alias("n_noise"))
    if expected is None:
        return out
    focus = found.join(expected.select("entity_id", "group"), "entity_id")
    shared = focus.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_label"))
    groups = focus.join(shared, [*keys, "label"]).groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("n_label").alias("n_label"))
    whole = (F.col("low") >= 0) & (F.col("low") == F.col("high")) & (F.col("n_label") == F.col("n"))
    scores = groups.groupBy(*keys).agg(F.count_if(F.when(F.col("n") == 1, (F.col("low") < 0) | whole).otherwise(whole)).alias("score"))
    return out.join(scores, keys, "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))


def standardized(items: DataFrame, column: str, most: float = 1.5) -> DataFrame:
    """``items`` with each place of the column in standard deviations, cut at ``most``, at unit length.

    Only a mean and a deviation for each place reach the driver.
    """
    places = items.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread")).orderBy("at").collect()
    mean, spread = [F.array(*[F.lit(float(r[c] or least)) for r in places]).cast("array<double>") for c, least in (("mean", 0.0), ("spread", 1.0))]
    scaled = F.zip_with(F.zip_with(column, mean, lambda x, m: x - m), spread, lambda x, d: F.greatest(F.lit(-most), F.least(F.lit(most), x / d)))
    return items.withColumn(column, normalized(scaled))


def fused_pipeline(items: DataFrame, epsilon: float = 0.03, color_weight: float = 0.4, near: float = 0.055, least: int = 2) -> DataFrame:
    """(entity_id, label) of (entity_id, vector, color, is_key): vectors and colours in one clustering.

    Clusters without a key item whose centroids are near become one, without regard to
    layout; so does noise with near noise. Of two or more noise items each one left over
    gets a label of its own. Labels are numbered by first members.
    """
    both = standardized(items, "color").select("entity_id", fused(F.col("vector"), F.col("color"), color_weight / (1 - color_weight)).alias("vector"))
    found = hierarchy.hdbscan(both, epsilon, least, "euclidean")
    rows = cut(items.select("entity_id", "vector", "is_key", F.lit(0.0).alias("asymmetry")).join(found, "entity_id"))
    held = rows.where("label >= 0 and is_key").select("label").distinct()
    free = rows.where("label >= 0").join(held, "label", "left_anti").select(*rows.columns)
    kept = rows.where("label < 0").unionByName(rows.where("label >= 0").join(held, "label", "left_semi").withColumn("label", F.col("label") * 2 + 1).select(*rows.columns))
    rows = cut(kept.unionByName(stages.merge(free, near, ANY_LAYOUT).withColumn("label", F.col("label") * 2).select(*rows.columns)))
    alone = rows.where("label < 0").count() < 2
    rows = cut(stages.pair_noise(rows, near))
    rooted = rows.where((F.col("label") >= 0) | (not alone)).select("entity_id", F.when(F.col("label") >= 0, F.col("label") * 2).otherwise(F.col("entity_id") * 2 + 1).alias("root"))
    return stages.relabelled(rows, stages.first_appearance(rooted, "root"), "entity_id", "rank").select("entity_id", "label")


def color_groups(items: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``items`` with the number ``pre`` of their k-means group of colours; the numbers are arbitrary."""
    k = min(k, items.limit(k).count())
    if k < 2:
        return items.withColumn("pre", F.lit(0))
    features = items.withColumn("_color", array_to_vector("color"))
    return KMeans(k=k, seed=seed, featuresCol="_color", predictionCol="pre").fit(features).transform(features).drop("_color")


def grouped_pipeline(items: DataFrame, k: int = 5, epsilon: float = 0.12, near: float = 0.30, layout: float = 0.05, least: int = 2) -> DataFrame:
    """(entity_id, label) of (entity_id, vector, color, asymmetry): clusters within groups of colours.

    Then clusters with near centroids become one whatever their layout, noise joins the
    nearest centroid, and layouts part last.
    """
    rows = cut(color_groups(items, k).select("entity_id", "vector", "asymmetry", "pre"))
    parts = []
    for pre in range(k):  # a number of groups given by the caller
        found = hierarchy.hdbscan(rows.where(F.col("pre") == pre), epsilon, least, "euclidean")
        parts.append(found.withColumn("label", F.when(F.col("label") >= 0, F.col("label") * k + pre).otherwise(-1)))
    first = parts[0]
    for part in parts[1:]:
        first = first.unionByName(part)
    rows = cut(rows.drop("pre").join(first, "entity_id"))
    for stage, limits in ((stages.merge, (near, ANY_LAYOUT)), (stages.recover_noise, (near,)), (stages.layout_split, (layout,))):
        rows = cut(stage(rows, *limits))
    return rows.select("entity_id", "label")


def group_folders(labels: DataFrame) -> DataFrame:
    """(label, folder, count, position): the folder of each group, the largest group first."""
    sized = labels.groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.min("entity_id").alias("first"))
    named = sized.withColumn("folder", F.when(F.col("label") < 0, "unique_or_noise").otherwise(F.format_string("template_%02d", "label")))
    return numbered(named, F.desc("count"), "first").select("label", "folder", "count", "position")


def write_groups(labels: DataFrame, names: DataFrame, path: str) -> None:
    """Writes (entity_id, filename) of every item below the folder of its group."""
    rows = labels.join(group_folders(labels).select("label", "folder"), "label").join(names.select("entity_id", "filename"), "entity_id", "left")
    rows.select("entity_id", "filename", "folder").write.mode("overwrite").partitionBy("folder").parquet(path)
