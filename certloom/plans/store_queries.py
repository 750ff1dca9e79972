"""Queries of the stored tables: documents as the images, labels as the finished ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.sources import store
from certloom.sources.records import table


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"))


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").where("doc_id is not null")
    return done.select(F.col("doc_id").alias("entity_id"), F.concat(F.lit("School "), (F.col("doc_id") % 11).cast("string")).alias("school"), F.lit(True).alias("ocr_done"))


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("entity_id"), F.when(F.col("quality") == 1, "低").otherwise("中").alias("ps_risk"))


def ocr_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.ocr_list(certificates(spark, sf_dir), finished(spark, sf_dir), assessed(spark, sf_dir)).select("entity_id", "filename", "school", "status", "ps_risk")


def filter_ocr_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.filter_list(ocr_list(spark, sf_dir), "done", "SCHOOL 7")


def ocr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("status") == "done"
    return ocr_list(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("ocr_done"), F.count_if(~done).alias("pending"), F.count_if(F.col("ps_risk") == "中").alias("suspicious"))


def pending_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without(certificates(spark, sf_dir), finished(spark, sf_dir))


def pending_ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without(finished(spark, sf_dir).select("entity_id", "school"), assessed(spark, sf_dir))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without an image: those of the embeddings beyond every third document."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), "label")
    return store.orphans(vectors, certificates(spark, sf_dir).where("entity_id % 3 = 0"))


def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, as upserts keep the newest row of an entity."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), "ts", "event_id", "event_type")
    return store.latest(events, "entity_id", "ts", F.desc("event_id")).select("entity_id", "event_id", "event_type")


def admin_ocr_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(finished(spark, sf_dir).select("entity_id", "school"), "entity_id", 2)


def id_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    certs = certificates(spark, sf_dir)
    scan = certs.withColumn("filename", F.concat(F.col("entity_id").cast("string"), F.lit(".jpg")))
    return store.id_universe(certs.where("entity_id % 2 = 0"), scan)


def three_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("vector"))
    found = store.fields_of(vectors, vectors, vectors.where("entity_id % 2 = 0"), vectors.where("entity_id % 3 = 0"))
    return found.select("entity_id", *[F.size(c).alias(c) for c in ("image_vector", "face_vector", "template_vector")])


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("documents", "labels", "embeddings", "events"):
        row = table(spark, sf_dir, name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {f.__name__: f for f in (ocr_list, filter_ocr_list, ocr_counts, pending_ocr, pending_ps, orphans, latest_upsert, admin_ocr_page, id_universe, three_stores, store_stats)}

_LIST = """certs as (select doc_id as entity_id, source||'_'||doc_id||'.png' as filename from documents), done as (select doc_id as entity_id, 'School '||(doc_id % 11) as school from labels where doc_id is not null),
 ps as (select doc_id as entity_id, case when quality = 1 then '低' else '中' end as ps_risk from labels where toxic = 0),
 listed as (select entity_id, filename, school, case when done.entity_id is not null then 'done' else 'pending' end as status, ps_risk from certs left join done using (entity_id) left join ps using (entity_id))"""

SQL = {
    "ocr_list": f"with {_LIST} select * from listed",
    "filter_ocr_list": f"with {_LIST} select * from listed where status = 'done' and (filename ilike '%school 7%' or school ilike '%school 7%')",
    "ocr_counts": f"with {_LIST} select count(*) as total, count(*) filter (status = 'done') as ocr_done, count(*) filter (status = 'pending') as pending, count(*) filter (ps_risk = '中') as suspicious from listed",
    "pending_ocr": f"with {_LIST} select * from certs where entity_id not in (select entity_id from done)",
    "pending_ps": f"with {_LIST} select * from done where entity_id not in (select entity_id from ps)",
    "orphans": "select vec_id as entity_id, label from embeddings where vec_id not in (select doc_id from documents where doc_id % 3 = 0)",
    "latest_upsert": "select user_id as entity_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1",
    "admin_ocr_page": f"with {_LIST} select * from done order by entity_id desc limit 50 offset 50",
    "id_universe": f"with {_LIST} select entity_id, case when entity_id % 2 = 0 then filename else entity_id||'.jpg' end as filename from certs",
    "three_stores": "select vec_id as entity_id, len(embedding)::int as image_vector, case when vec_id % 2 = 0 then len(embedding) else 0 end::int as face_vector, case when vec_id % 3 = 0 then len(embedding) else 0 end::int as template_vector from embeddings",
    "store_stats": "select 'documents' as table, count(*) as n from documents union all select 'labels', count(*) from labels union all select 'embeddings', count(*) from embeddings union all select 'events', count(*) from events",
}
