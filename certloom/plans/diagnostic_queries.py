"""Queries that describe distances, groups and detections for choosing thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions.vectors import fused, norm
from certloom.operators import faces, pair_stats
from certloom.sources.records import table, vectors


def best_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best face of each order, whose line items stand for detections."""
    found = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("face_no"), F.round(F.col("l_discount") * 10, 6).alias("det_score"), (F.col("l_quantity") * 4).alias("width"), (F.col("l_quantity") * 5).alias("height")
    )
    return faces.best_faces(found)


def nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten pairs of vectors that are nearest to each other."""
    return pair_stats.Distances(vectors(spark, sf_dir), "euclidean").least(10).select("a", "b", F.round("distance", 6).alias("distance"))


def farthest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_stats.Distances(vectors(spark, sf_dir), "euclidean").least(10, greatest=True).select("a", "b", F.round("distance", 6).alias("distance"))


def group_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances within each pair of labels: pairs, least, greatest, mean."""
    found = pair_stats.between_groups(vectors(spark, sf_dir))
    return found.select("label1", "label2", "pairs", *[F.round(c, 6).alias(c) for c in ("least", "greatest", "mean")])


def item_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each vector is from the others of its label."""
    found = pair_stats.within_groups(vectors(spark, sf_dir))
    return found.select("entity_id", *[F.round(c, 6).alias(c) for c in ("least", "greatest", "mean")])


def template_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings joined with a colour part weighted 1.5, at unit length."""
    color = F.slice("vector", 1, 8)
    found = vectors(spark, sf_dir).select("entity_id", fused(F.col("vector"), color, 1.5).alias("v"))
    return found.select("entity_id", F.size("v").alias("dim"), F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), F.round(norm(F.col("v")), 6).alias("norm"))


QUERIES = {f.__name__: f for f in (best_faces, nearest_pairs, farthest_pairs, group_distances, item_distances, template_vectors)}

_V = "v as (select vec_id as id, cast(embedding as double[]) as x, label from embeddings)"
_E = f"{_V}, p as (select a.id as a, b.id as b, list_distance(a.x, b.x) as d from v a join v b on a.id < b.id)"
_C = f"{_V}, p as (select a.id as a, b.id as b, a.label as x, b.label as y, 1 - list_cosine_similarity(a.x, b.x) as d from v a join v b on a.id < b.id)"

SQL = {
    "best_faces": """with f as (select l_orderkey as entity_id, l_linenumber as face_no, round(l_discount * 10, 6) as det_score from lineitem where round(l_discount * 10, 6) >= 0.5 and l_quantity * 4 >= 80),
 r as (select *, row_number() over (partition by entity_id order by det_score desc, face_no) as n from f) select entity_id, face_no, det_score from r where n = 1""",
    "nearest_pairs": f"with {_E} select a, b, round(d, 6) as distance from p order by d, a, b limit 10",
    "farthest_pairs": f"with {_E} select a, b, round(d, 6) as distance from p order by d desc, a, b limit 10",
    "group_distances": f"with {_C} select least(x, y) as label1, greatest(x, y) as label2, count(*) as pairs, round(min(d), 6) as least, round(max(d), 6) as greatest, round(avg(d), 6) as mean from p group by 1, 2",
    "item_distances": f"""with {_C}, w as (select a as id, d from p where x = y union all select b, d from p where x = y)
 select id as entity_id, round(min(d), 6) as least, round(max(d), 6) as greatest, round(avg(d), 6) as mean from w group by id""",
    "template_vectors": f"""with {_V}, j as (select id, x || list_transform(x[1:8], lambda c: c * 1.5::double) as v from v), u as (select id, v, sqrt(list_dot_product(v, v)) as n from j)
 select id as entity_id, len(v)::int as dim, round(v[1] / n, 6) as first, round(v[-1] / n, 6) as last, 1.0::double as norm from u""",
}
