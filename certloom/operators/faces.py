"""Choice among the faces detected in an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.config import SETTINGS, Settings


def good_faces(faces: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Faces that are sure and large enough. ``faces``: det_score, width, height."""
    return faces.where((F.col("det_score") >= s.face_min_score) & (F.least("width", "height") >= s.face_min_side))


def best_faces(faces: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The surest good face of each entity, the first of equals.

    ``faces``: entity_id, face_no, det_score, width, height.
    """
    best = F.max_by(F.struct("face_no", "det_score"), F.struct("det_score", -F.col("face_no")))
    return good_faces(faces, s).groupBy("entity_id").agg(best.alias("f")).select("entity_id", "f.face_no", "f.det_score")
