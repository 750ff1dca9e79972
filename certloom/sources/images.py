"""Image files of a folder: validity, names and pixels, by Spark's own readers, also as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.config import SETTINGS, Settings


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def entity_of(path: Column, s: Settings = SETTINGS) -> Column:
    """The id of a file named by digits with an allowed extension, else null."""
    stem = F.regexp_extract(path, rf"(?i)/([0-9]+)\.(?:{'|'.join(s.extensions)})$", 1)
    return F.when(stem != "", stem.try_cast("bigint"))


def files(spark: SparkSession, folder: str, recursive: bool = False, s: Settings = SETTINGS) -> DataFrame:
    """(path, length, content, extension, entity_id, is_valid) of the files of a folder.

    Valid: an allowed extension, in any case, and at most the size limit. Whether a file
    decodes is known once its pixels are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.select("path", "length", "content", extension(F.col("path")).alias("extension"), entity_of(F.col("path"), s).alias("entity_id")).withColumn(
        "is_valid", F.col("extension").isin(*s.extensions) & (F.col("length") <= s.max_file_bytes)
    )


def stored_ids(spark: SparkSession, folder: str, s: Settings = SETTINGS) -> DataFrame:
    """(entity_id, filename) of the stored images; contents are not read."""
    path = F.col("path")
    return spark.read.format("binaryFile").load(folder).select(entity_of(path, s).alias("entity_id"), F.regexp_extract(path, "([^/]+)$", 1).alias("filename")).where("entity_id is not null")


#: What the image reader gives; a stream needs it stated.
IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
UNREADABLE = "image cannot be decoded"


def pixels(spark: SparkSession, folder: str, stream: bool = False, s: Settings = SETTINGS) -> DataFrame:
    """(path, entity_id, height, width, channels, data, error) of the images of a folder, or
    of those that arrive in it.

    Files with an allowed extension are images, others are left out. Data is BGR; a file
    that doesn't decode is a row without sizes and data, and with an error. The id is null
    if the name is no number. An empty folder has no rows, and Spark's
    listing leaves out files without a byte: a join with the known ids shows those.
    """
    reader = (spark.readStream if stream else spark.read).format("image").schema(IMAGE).option("dropInvalid", False)
    reader = reader.option("pathGlobFilter", "*.{%s}" % ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in s.extensions))
    found = reader.load(folder)
    path = F.col("image.origin")
    decoded = F.coalesce(F.col("image.height") > 0, F.lit(False))
    part = lambda name, new: F.when(decoded, F.col(f"image.{name}")).alias(new)
    return found.select(
        path.alias("path"), entity_of(path, s).alias("entity_id"), part("height", "height"), part("width", "width"), part("nChannels", "channels"), part("data", "data"),
        F.when(~decoded, F.lit(UNREADABLE)).alias("error"),
    )
