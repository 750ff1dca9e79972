"""Helpers shared by the corpus operators: reading tables, batches, small sides of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.operators.lineage import cut, scratch_folder  # noqa: F401 (for the operators)

#: Bytes of one Arrow batch handed to a Python worker, so that long texts do not
#: multiply with the row limit of a batch.
BATCH_BYTES = 4 * 1024 * 1024
BATCH_ROWS = 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes and rows for the queries of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def few(ids: DataFrame, most: int) -> DataFrame:
    """The rows, to be sent to every task if there are not more than ``most``."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def map_rows(
    df: DataFrame,
    schema: T.StructType,
    make: Callable[[], Callable[[Sequence[Sequence]], Sequence[Sequence]]],
) -> DataFrame:
    """Run a batch function over ``df`` through Arrow.

    ``make`` is called once per task and returns a function that takes the columns
    of a batch as Python lists and returns the output columns as lists.
    """
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            step = step or make()
            cols = step([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)
            del batch, cols
        # workers outlive their tasks: what Arrow keeps for later goes back
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    """The Arrow schema of the few types that the operators exchange."""
    kinds = {"string": pa.string(), "long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def kind(t: T.DataType) -> pa.DataType:
        if isinstance(t, T.ArrayType):
            return pa.list_(kind(t.elementType))
        return kinds[t.typeName()]

    return pa.schema([pa.field(f.name, kind(f.dataType)) for f in schema])
