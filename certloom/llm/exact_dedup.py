"""Exact deduplication by 128-bit content hash with a byte comparison.

Texts are equal when they are identical after lower-casing A-Z only. Rows are first
aggregated by (hash, text): the hash is what is shuffled and sorted on, and Spark's
own comparison of the grouping text is the byte comparison that keeps colliding
hashes apart. Copies of one text in one task collapse before the shuffle, so a hot
group arrives as one row for each map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.llm.common import cut, few

#: Dropped rows up to which they are sent to every task (about 20 MB).
BROADCAST_ROWS = 150_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(column: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null becomes empty.

    For pure ASCII texts ``lower`` does the same as ``translate`` and is faster.
    """
    text = F.coalesce(column, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row for each row of ``docs`` that says which row of its group stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null texts count as
    empty. Of equal texts the row with the largest id stays (``keep="smallest"``:
    the smallest). Rows with a null id belong to their group and are never the one
    kept unless the whole group has null ids; repeated ids stay repeated rows, all
    of them ``kept`` when their id is the one that stays. Other columns are ignored.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(docs[text_col]).alias("_t"))
    # the 128-bit hash and the digest are taken from the same normalised text
    groups = (
        rows.withColumn("_h", F.md5("_t"))
        .groupBy("_h", "_t")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_h", F.sha2("_t", 256).alias("_sha"), "keep_id", "group_size")
    )
    keyed = rows.select("doc_id", F.md5("_t").alias("_h"), F.sha2("_t", 256).alias("_sha"))
    # 384 bits of two unrelated hashes carry the byte comparison's outcome back to
    # the rows without moving their texts a second time.
    return keyed.join(groups, ["_h", "_sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` without the copies, all columns kept (see :func:`mark_copies`).

    Rows that repeat both the id that stays and its text all stay. The rows to drop are
    few in a corpus with few copies; then texts are shuffled for the comparison only.
    Columns may have any names; an empty table stays empty.
    """
    gone = cut(mark_copies(docs, id_col, text_col, keep).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct())
    gone = few(gone, BROADCAST_ROWS)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.sha2(normalised(docs[text_col]), 256) == gone["_sha"]), "left_anti")
