"""Taking images in: names, ids, vectors with zeros for failures, certificates once.

Model calls are hooks: ``extract`` runs any function over images or texts in Arrow
batches, and ``recognised`` calls it only for the records that need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.config import SETTINGS, Settings
from certloom.functions.vectors import or_zeros
from certloom.operators.lineage import cut
from certloom.operators.order import numbered
from certloom.sources.images import extension
from certloom.sources.store import Store, insert_missing, without

#: Vector fields of a certificate and their numbers of components.
VECTOR_FIELDS = {"image": "image_dim", "face": "face_dim", "template": "template_dim"}


def accepted(candidates: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The files of an upload or a folder that can be taken in. ``candidates``: path, length."""
    return candidates.withColumn("extension", extension(F.col("path"))).where(F.col("extension").isin(*s.extensions) & (F.col("length") <= s.max_file_bytes))


def stored_name(entity_id: Column, ext: Column, s: Settings = SETTINGS) -> Column:
    """The id and the extension, .png for an unknown one."""
    return F.concat(entity_id.cast("string"), F.lit("."), F.when(F.lower(ext).isin(*s.extensions), F.lower(ext)).otherwise("png"))


def with_ids(files: DataFrame, known: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """``files`` with ids after the largest known one, in the order of their paths, and the
    names that they are stored by. ``known``: entity_id."""
    last = known.agg(F.coalesce(F.max("entity_id"), F.lit(0)).alias("last")).first()["last"]
    placed = numbered(files, "path")
    return placed.withColumn("entity_id", F.lit(last) + 1 + F.col("position")).drop("position").withColumn("filename", stored_name(F.col("entity_id"), F.col("extension"), s))


def vector_rows(rows: DataFrame, dims: dict[str, int]) -> DataFrame:
    """(entity_id, vector_field, vector): one row a field, zeros where an extractor failed.

    ``rows``: entity_id and a column <field>_vector for each field of ``dims``.
    """
    structs = [F.struct(F.lit(name).alias("vector_field"), or_zeros(F.col(f"{name}_vector").cast("array<double>"), dim).alias("vector")) for name, dim in dims.items()]
    return rows.select("entity_id", F.explode(F.array(*structs)).alias("v")).select("entity_id", "v.vector_field", "v.vector")


def certificates_of(rows: DataFrame) -> DataFrame:
    """Rows of the certificates' table: a face was found if its vector is not zero."""
    has_face = F.coalesce(F.exists("face_vector", lambda x: x != 0), F.lit(False))
    return rows.select(F.col("entity_id").alias("id"), "filename", has_face.alias("has_face"), F.current_timestamp().alias("upload_time"))


def ingest(store: Store, files: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Take in files (path, length, image_vector, face_vector, template_vector).

    The vectors of all files and the certificates that aren't there yet are one commit, so
    that none is stored without the others. Returns entity_id, path and filename.
    """
    known = store.read("vectors").select("entity_id")
    rows = cut(with_ids(accepted(files, s), known, s))
    vectors = vector_rows(rows, {name: getattr(s, dim) for name, dim in VECTOR_FIELDS.items()})
    store.commit(added={"vectors": vectors, "certificates": insert_missing(store.read("certificates"), certificates_of(rows))})
    return rows.select("entity_id", "path", "filename")


def image_by_id(stored: DataFrame, entity_id: int) -> DataFrame:
    """The stored image of an id, by the first allowed extension. ``stored``: entity_id, filename."""
    place = F.array_position(F.array(*map(F.lit, SETTINGS.extensions)), extension(F.concat(F.lit("/"), F.col("filename"))))
    return stored.where(F.col("entity_id") == entity_id).orderBy(place).limit(1)


def file_names(table: DataFrame, scan: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(entity_id, filename) of all or of the named ids; of the scan if the table is empty."""
    source = scan if table.isEmpty() else table
    found = source.select("entity_id", "filename")
    return found if ids is None else found.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def extract(rows: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: T.StructType | str) -> DataFrame:
    """A model's answers on batches of rows. ``make`` loads it once for each task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or make()
            yield model(frame)

    return rows.mapInPandas(run, schema)


def recognised(rows: DataFrame, done: DataFrame, answer: Callable[[DataFrame], DataFrame], again: bool = False) -> DataFrame:
    """Answers for ``rows``: stored ones (``done``), and new ones for the rest or, with
    ``again``, for all. Both have entity_id and the columns of ``done``."""
    if again:
        return answer(rows).select(*done.columns)
    kept = done.join(rows.select("entity_id"), "entity_id", "left_semi")
    return kept.unionByName(answer(without(rows, done)).select(*done.columns))
