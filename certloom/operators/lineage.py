"""Intermediate tables in the folder that the driver and all executors share.

A table that is written and read again cuts the lineage, survives lost executors, and
is read by few tasks if it is small. Shuffle files of the job that wrote it are let go
with it. Tables are deleted when their job drops them, and at the latest when the
driver's process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Names in Spark's versions of the setting that frees a write's shuffle files.
_CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")
_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is set where none is, in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="certloom-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder and all below it, by the file system that it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one, deleted when the driver ends."""
    key = spark.sparkContext.applicationId
    if key not in _SCRATCH:
        _SCRATCH[key] = f"{shared_folder(spark)}/certloom-{uuid.uuid4().hex}"

        def clear(folder: str = _SCRATCH[key]) -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                delete(spark, folder)

        atexit.register(clear)
    return _SCRATCH[key]


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Writes within it free their shuffle files when they are done."""
    known = {k: spark.conf.get(k, None) for k in _CLEANUP}
    known = {k: v for k, v in known.items() if v is not None}
    for k in known:
        spark.conf.set(k, "true")
    try:
        yield
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a Parquet table in ``folder``, read again."""
    spark = df.sparkSession
    with shuffles_freed(spark):
        df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the scratch folder; its lineage ends there."""
    return written(df, f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}")


class Tables:
    """The named intermediate tables of one job; a name that is kept anew replaces the old."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
        self.at: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        old, self.at[name] = self.at.get(name), f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        table = written(df, self.at[name])
        if old:
            delete(self.spark, old)
        return table

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.at:
                delete(self.spark, self.at.pop(name))

    def drop_all(self) -> None:
        delete(self.spark, self.folder)
        self.at.clear()
