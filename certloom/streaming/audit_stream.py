"""Batch and incremental audit: an outcome, an event and stored results for each record.

A record without an image is skipped, one whose image doesn't decode is an error, and all
others are audited: failed recognition leaves them without fields, failed forensics without
flags. ``records`` have the fields, the face's attributes, and these columns, each of which
may be absent: filename, has_image, image_error (text), ocr_error, risk_flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from certloom.config import SETTINGS, Settings
from certloom.operators.lineage import Tables
from certloom.operators.order import numbered
from certloom.operators.rules import record_issues, risk_level
from certloom.sources.store import Store, single_issues_replaced

_ISSUES = "array<struct<rule:string,detail:string,severity:string,related_ids:array<bigint>>>"
#: Keyed state lies on the executors' disks, not in their memory.
_PROVIDER, _ON_DISK = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What an absent column of a record counts as.
_ABSENT = {"filename": "cast(null as string)", "has_image": "true", "image_error": "cast(null as string)", "ocr_error": "false", "risk_flags": "cast(array() as array<string>)", "face_age": "cast(null as double)", "face_gender": "cast(null as string)"}


def audited(records: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The records with status (ok, skip, error), error, issues of all five rules, risk_flags
    and risk_level; the last three are empty or null unless the status is ok."""
    rows = records.withColumns({c: F.expr(x) for c, x in _ABSENT.items() if c not in records.columns})
    unread = F.coalesce("ocr_error", F.lit(False))
    fields = [c for c in s.fields if c in rows.columns]
    rows = rows.withColumns({c: F.when(~unread, F.col(c)) for c in fields})
    status = F.when(~F.coalesce("has_image", F.lit(False)), "skip").when(F.col("image_error").isNotNull(), "error").otherwise("ok")
    rows = rows.withColumn("status", status).withColumn("error", F.when(F.col("status") == "skip", "image not found").when(F.col("status") == "error", F.col("image_error")))
    ok = F.col("status") == "ok"
    empty = lambda kind: F.array().cast(kind)
    rows = rows.withColumn("issues", F.when(ok, record_issues(s)).otherwise(empty(_ISSUES)))
    rows = rows.withColumn("risk_flags", F.when(ok, F.coalesce("risk_flags", empty("array<string>"))).otherwise(empty("array<string>")))
    return rows.withColumn("risk_level", F.when(ok, risk_level(F.col("issues"), F.col("risk_flags"))))


def events(outcomes: DataFrame, before: int = 0) -> DataFrame:
    """(done, total, id, filename, status, risk_level, error): an event for each record, in the
    order of their ids, the first of them being the one after ``before`` others."""
    placed = numbered(outcomes.select("entity_id", "filename", "status", "risk_level", "error"), "entity_id")
    total = F.lit(before + outcomes.count())
    return placed.select((F.col("position") + 1 + before).alias("done"), total.cast("long").alias("total"), F.col("entity_id").alias("id"), "filename", "status", "risk_level", "error")


def results_of(outcomes: DataFrame, store: Store, s: Settings = SETTINGS) -> dict[str, dict[str, DataFrame]]:
    """The changes that audited records make to the stored tables: their fields, flags and
    single issues, as arguments of ``Store.commit``. Skipped records and errors make none."""
    ok = outcomes.where("status = 'ok'").withColumn("created_at", F.current_timestamp())
    fields = [c for c in s.fields if c in outcomes.columns]
    issues = ok.select("entity_id", F.explode("issues").alias("i")).select("entity_id", "i.rule", "i.detail", "i.severity")
    single = single_issues_replaced(store.read("fraud_issues"), issues, ok.select("entity_id"))
    return {
        "added": {"ocr_results": ok.select("entity_id", "created_at", *fields), "forensic_results": ok.select("entity_id", "created_at", "risk_flags", _forensic_level())},
        "replaced": {"fraud_issues": single},
    }


def _forensic_level() -> Column:
    from certloom.operators.rules import forensic_level

    return forensic_level(F.col("risk_flags")).alias("risk_level")


def batch_analyze(records: DataFrame, store: Store | None = None, s: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    """The outcomes and the events of all records, whose results are stored by one commit."""
    tables = Tables(records.sparkSession)
    outcomes = tables.keep("outcomes", audited(records.dropDuplicates(["entity_id"]), s))
    if store is not None:
        store.commit(**results_of(outcomes, store, s))
    return outcomes, events(outcomes)


def batch_analyze_stream(
    spark: SparkSession, source: str, schema: T.StructType, results: str, progress: str, checkpoint: str, store: Store | None = None, s: Settings = SETTINGS
) -> StreamingQuery:
    """Audit the record files below ``source`` as they come, and stop at the end.

    Entities that were seen before are dropped by Spark's keyed state, so that a batch costs
    what its own records cost. It writes its outcomes (``results``), an event for each record
    (``results``_events) and a progress row (batch, total, ok, skip, error, done), in
    folders of its number: a batch that is repeated after a failure replaces what it wrote,
    and its commit to the ``store`` is left out if it was made already.
    """

    def write(batch: DataFrame, number: int) -> None:
        part = f"batch={number}"
        audited(batch, s).write.mode("overwrite").parquet(f"{results}/{part}")
        outcomes = spark.read.parquet(f"{results}/{part}")
        before = _done_before(spark, progress, number)
        events(outcomes, before).write.mode("overwrite").parquet(f"{results}_events/{part}")
        if store is not None:
            store.commit(**results_of(outcomes, store, s), source=checkpoint, number=number)
        status = lambda name: F.count_if(F.col("status") == name).alias(name)
        total = F.count(F.lit(1))
        counted = outcomes.agg(total.alias("total"), status("ok"), status("skip"), status("error"), (total + before).alias("done"))
        counted.write.mode("overwrite").parquet(f"{progress}/{part}")

    fresh = spark.readStream.schema(schema).parquet(source).dropDuplicates(["entity_id"])
    kept = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ON_DISK)  # a query keeps what is set when it starts
    try:
        return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if kept is None else spark.conf.set(_PROVIDER, kept)


def _done_before(spark: SparkSession, progress: str, number: int) -> int:
    """Records of earlier batches, by the progress row of the one before."""
    return spark.read.parquet(f"{progress}/batch={number - 1}").first()["done"] if number else 0
