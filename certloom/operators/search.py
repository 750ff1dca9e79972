"""Exact top-k search by cosine similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.config import SETTINGS, Settings
from certloom.functions.vectors import cosine


def check_request(vector: Sequence[float] | None, entity_id: int | None, dim: int, top_k: int, s: Settings = SETTINGS) -> None:
    """ValueError unless exactly one of vector and id is given and both limits hold."""
    if (vector is None) == (entity_id is None):
        raise ValueError("give a vector or an entity_id")
    if vector is not None and len(vector) != dim:
        raise ValueError(f"the vector has {len(vector)} components, not {dim}")
    if not 1 <= top_k <= s.max_top_k:
        raise ValueError(f"top_k is not within 1 and {s.max_top_k}")


def search(store: DataFrame, vector: Sequence[float], top_k: int | None = None, exclude_self: bool = False, s: Settings = SETTINGS) -> DataFrame:
    """(entity_id, score, distance, is_abnormal), nearest first, ties by id.

    ``store``: entity_id, vector. The query travels in the plan, every partition keeps
    its best, and only those meet. ``exclude_self`` leaves out matches nearer than
    ``self_match_distance``; ``is_abnormal`` says that a score is above the threshold.
    """
    query = F.array(*[F.lit(float(x)) for x in vector])
    scored = store.select("entity_id", cosine(F.col("vector"), query).alias("score")).where("score is not null").withColumn("distance", 1 - F.col("score"))
    if exclude_self:
        scored = scored.where(F.col("distance") >= s.self_match_distance)
    best = scored.orderBy(F.desc("score"), "entity_id").limit(top_k or s.default_top_k)
    return best.withColumn("is_abnormal", F.col("score") > s.similarity_threshold)


def search_by_id(store: DataFrame, entity_id: int, top_k: int | None = None, exclude_self: bool = False, s: Settings = SETTINGS) -> DataFrame:
    """As ``search``, for the vector of a stored entity; LookupError if it has none."""
    row = store.where(F.col("entity_id") == entity_id).select("vector").first()
    if row is None or not row["vector"]:
        raise LookupError(f"entity {entity_id} has no vector")
    return search(store, row["vector"], top_k, exclude_self, s)
