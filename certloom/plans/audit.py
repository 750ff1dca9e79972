"""Whole audits: one record, all records, and what the stored tables keep of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.config import SETTINGS, Settings
from certloom.operators import rules
from certloom.operators.lineage import cut, scratch_folder
from certloom.operators.similarity import similar_hashes
from certloom.sources.records import credentials, faces, forensic_metrics
from certloom.streaming.audit_stream import audited, batch_analyze_stream


def analyze(record: DataFrame, flags: DataFrame | None = None, s: Settings = SETTINGS) -> DataFrame:
    """(entity_id, issues, risk_flags, risk_level, all_flags) of records, with forensic flags
    if given; all_flags are those flags and the names of the rules."""
    found = record.select("entity_id", rules.record_issues(s).alias("issues"))
    if flags is not None:
        found = found.join(flags.select("entity_id", "risk_flags"), "entity_id", "left")
    else:
        found = found.withColumn("risk_flags", F.lit(None).cast("array<string>"))
    found = found.withColumn("risk_flags", F.coalesce("risk_flags", F.array().cast("array<string>")))
    named = F.concat("risk_flags", F.transform("issues", lambda i: i["rule"]))
    return found.withColumns({"risk_level": rules.risk_level(F.col("issues"), F.col("risk_flags")), "all_flags": named})


def hash_issues(hashes: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Issues of images with nearly the same region. ``hashes``: entity_id, region, w0..w3."""
    pairs = similar_hashes(hashes, s.hamming_threshold, "region")
    detail = F.concat(F.lit("ID "), F.col("id1").cast("string"), F.lit(" 与 ID "), F.col("id2").cast("string"), F.lit(" 的"), "region", F.lit("区域哈希距离 "), F.col("distance").cast("string"))
    return pairs.select(F.lit("区域图像高度相似").alias("rule"), detail.alias("detail"), F.lit(rules.HIGH).alias("severity"), F.array("id1", "id2").alias("related_ids"))


def all_issues(records: DataFrame, hashes: DataFrame | None = None, s: Settings = SETTINGS) -> DataFrame:
    """The issues of all rules across records, and those of the images' regions if given."""
    issues = rules.cross_issues(records, s)
    return issues if hashes is None else issues.unionByName(hash_issues(hashes, s))


def run_header(records: DataFrame, issues: DataFrame) -> DataFrame:
    """The header of a run. Of the issues only what is counted is made: neither their texts nor
    a table of them."""
    totals = records.agg(F.count(F.lit(1)).alias("total_certs"), F.count_if(~F.coalesce(F.col("ocr_error"), F.lit(False))).alias("ocr_success"))
    counted = issues.agg(F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("severity") == rules.HIGH).alias("high_severity_count"))
    header = totals.withColumn("_run", F.lit(1)).join(counted.withColumn("_run", F.lit(1)), "_run").drop("_run")
    message = F.concat(F.lit("共 "), F.col("total_certs").cast("string"), F.lit(" 张证件，发现 "), F.col("issue_count").cast("string"), F.lit(" 个问题"))
    return header.withColumn("message", message)


def cross_validate(records: DataFrame, hashes: DataFrame | None = None, s: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    """The issues across records, and the header of the run."""
    issues = cut(all_issues(records, hashes, s))
    return issues, run_header(records, issues)


def batch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials with faces and forensic flags; some without an image or with a broken one."""
    k = F.col("entity_id")
    # of several measurements of one image the most suspicious values count
    metrics = forensic_metrics(spark, sf_dir).groupBy("entity_id").agg(*[F.max(c).alias(c) for c in ("ela_std", "bright_ratio", "max_gradient", "noise_ratio", "red_count")], F.min("color_variance").alias("color_variance"))
    flags = metrics.select("entity_id", rules.forensic_flags().alias("risk_flags"))
    records = credentials(spark, sf_dir).join(faces(spark, sf_dir), "entity_id", "left").join(flags, "entity_id", "left")
    broken = F.when(k % 83 == 0, "cannot identify image file")
    return records.withColumns({"filename": F.concat(k.cast("string"), F.lit(".png")), "has_image": k % 89 != 0, "image_error": broken})


def _outcome(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("entity_id", "status", "error", "risk_level", F.size("issues").alias("n_issues"), F.size("risk_flags").alias("n_flags"))


def _stream(spark: SparkSession, sf_dir: str) -> str:
    """The folder in which the streaming audit of the records of a data folder has ended."""
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    records = batch_records(spark, sf_dir)
    records.write.parquet(f"{folder}/records")
    batch_analyze_stream(spark, f"{folder}/records", records.schema, f"{folder}/results", f"{folder}/progress", f"{folder}/checkpoint").awaitTermination()
    return folder


def batch_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming audit of the records of a folder, read back when it has ended."""
    return _outcome(spark.read.parquet(f"{_stream(spark, sf_dir)}/results"))


def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the streaming audit: how far it is at each record."""
    found = spark.read.parquet(f"{_stream(spark, sf_dir)}/results_events")
    return found.select("done", "total", "id", "filename", "status", "risk_level", "error")


def batch_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same audit without a stream."""
    return _outcome(audited(batch_records(spark, sf_dir)))
