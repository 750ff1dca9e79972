"""Audit inputs derived from the star-schema tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew for work that costs much a row: a table's files may be read by few
    tasks, or by many of which one has nearly all rows, as a file of one row group is."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One credential record for each order; years and numbers are strings."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("ck"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("nk"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nn"))
    base = orders.join(customer, "ck").join(nation, "nk").withColumn("gy", F.expr("1980 + (k * 7) % 40"))
    return base.selectExpr(
        "k as entity_id",
        "nn || '大学' as school",
        """case when k % 97 = 0 then 'P' || string(k % 40) when k % 19 = 0 then null
           else 'P_' || string(nk) || '_' || string(case when nk % 2 = 0 then gy div 10 else gy div 16 end) end as principal""",
        "case when k % 211 = 0 then 'N/A' else string(gy) end as grad_year",
        "string(case when k % 101 = 0 then gy + 1 else gy - (k % 7) end) as enrollment_year",
        "string(gy + (k % 6) - 1) as issue_year",
        "case when k % 11 = 0 then null when k % 13 = 0 then '' else string(gy - (k % 7) - 13 - (ck % 20)) end as birth_year",
        "case when ck % 2 = 0 then '男' else '女' end as gender",
        "lpad(string(((case when k % 50 = 0 and k > 0 then k - 1 else k end) * 7919) % 1000000000), 9, '0') as cert_no",
        "k % 113 = 0 as ocr_error",
    )


CREDENTIALS_SQL = """b as (
  select o_orderkey k, o_custkey ck, n_nationkey nk, n_name nn, 1980 + (o_orderkey*7)%40 gy
  from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey),
certs as (select k as entity_id, nn||'大学' as school,
 case when k%97=0 then 'P'||cast(k%40 as varchar) when k%19=0 then null
      else 'P_'||cast(nk as varchar)||'_'||cast(case when nk%2=0 then gy//10 else gy//16 end as varchar) end as principal,
 case when k%211=0 then 'N/A' else cast(gy as varchar) end as grad_year,
 cast(case when k%101=0 then gy+1 else gy-(k%7) end as varchar) as enrollment_year,
 cast(gy+(k%6)-1 as varchar) as issue_year,
 case when k%11=0 then null when k%13=0 then '' else cast(gy-(k%7)-13-(ck%20) as varchar) end as birth_year,
 case when ck%2=0 then '男' else '女' end as gender,
 lpad(cast(((case when k%50=0 and k>0 then k-1 else k end)*7919)%1000000000 as varchar),9,'0') as cert_no,
 k%113=0 as ocr_error
 from b)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face attributes of the credentials: age, gender as M/F, detector score."""
    certs = credentials(spark, sf_dir).select("entity_id", "gender")
    flipped = F.col("entity_id") % 10 == 0
    return certs.select(
        "entity_id",
        (10 + F.col("entity_id") % 35).cast("int").alias("face_age"),
        F.when((F.col("gender") == "男") != flipped, "M").otherwise("F").alias("face_gender"),
        ((F.col("entity_id") % 100) / 100.0).alias("det_score"),
    )


FACES_SQL = """faces as (select entity_id, cast(10 + entity_id % 35 as int) as face_age,
 case when (gender = '男') <> (entity_id % 10 = 0) then 'M' else 'F' end as face_gender,
 (entity_id % 100) / 100.0 as det_score from certs)"""


def _chinese(year: Column) -> Column:
    return F.translate(year, "0123456789", "〇一二三四五六七八九")


def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text of the credentials in four layouts, by entity_id mod 4."""
    c = spread(credentials(spark, sf_dir))
    k, born = F.col("entity_id"), (F.col("enrollment_year").cast("int") - 18).cast("string")
    modern = F.concat_ws(
        "\n",
        F.lit("毕业证书"),
        F.concat(F.when(k % 12 == 8, "兹证明 王小明 同学 性别：").otherwise("学生 张三丰 性别："), "gender"),
        F.concat(F.lit("毕业时间："), F.coalesce("grad_year", F.lit("")), F.lit(" 入学："), "enrollment_year"),
        F.concat(F.lit("证书编号："), "cert_no"),
        F.concat(F.lit("校长："), F.coalesce("principal", F.lit(""))),
        F.col("school"),
        F.when(k % 12 == 4, F.concat(F.lit("学籍号："), F.lpad(k.cast("string"), 12, "2"))),
        F.when(k % 16 == 0, F.concat(F.lit("身份证 110101"), born, F.lit("0101123X"))),
        F.when(k % 16 == 4, F.concat(F.lit("出生："), born)),
        F.when(k % 12 == 0, F.lit("河北省教育厅监制")),
    )
    old = F.concat(
        F.lit("学生李四光性别："), "gender", F.lit("，于"), _chinese(F.col("enrollment_year")), F.lit("年九月至"), _chinese(F.col("grad_year")), F.lit("年七月在本校 历史系 学习\n"),
        F.lit("编号："), "cert_no", F.lit("\n"), "school", F.lit("\n"), _chinese(F.col("issue_year")), F.lit("年七月廿日"),
        F.when(k % 8 == 1, F.concat(F.lit("\n生于"), _chinese(born), F.lit("年"))).otherwise(""),
    )
    verdicts = F.array(*map(F.lit, ("高度疑似PS", "疑似修改", "几乎确定伪造", "真实", None)))
    plain = F.to_json(F.struct("school", "principal", F.col("grad_year"), F.col("enrollment_year"), F.col("cert_no"), F.col("gender"), F.element_at(verdicts, (F.floor(k / 4) % 5 + 1).cast("int")).alias("ps_overall_authenticity"), (k % 100).cast("string").alias("ps_confidence")))
    evidence = F.when(k % 3 == 0, F.lit('["甲", "", null, "乙"]')).when(k % 3 == 1, F.lit('"单条"')).otherwise(F.lit("[]"))
    as_json = F.concat(F.regexp_replace(plain, r"\}$", ""), F.lit(',"ps_key_evidence":'), evidence, F.lit("}"))
    fenced = F.concat(F.lit("```json\n"), as_json, F.lit("\n```"))
    kind = F.col("entity_id") % 4
    return c.select("entity_id", F.when(kind == 0, modern).when(kind == 1, old).when(kind == 2, as_json).otherwise(fenced).alias("ocr_text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, vector, label) from the embeddings, components as doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def face_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``vectors``, with every 25th vector zero, as where no face was found."""
    return vectors(spark, sf_dir).withColumn("vector", F.when(F.col("entity_id") % 25 == 0, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector")))


def region_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 256-bit hash of each document as four 64-bit words."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as entity_id",
        "((doc_id div 4 + 1) * 2654435761L) ^ (shiftleft(1L, cast((doc_id % 4) * 5 as int)) - 1) as w0",
        "(doc_id div 4 + 1) * 2246822519L as w1",
        "(doc_id div 4 + 1) * 3266489917L as w2",
        "(doc_id div 4 + 1) * 668265263L as w3",
    )


HASHES_SQL = """hashes as (select doc_id as entity_id,
 xor((doc_id//4+1)*2654435761, (cast(1 as bigint) << cast((doc_id%4)*5 as int)) - 1) as w0,
 (doc_id//4+1)*2246822519 as w1, (doc_id//4+1)*3266489917 as w2, (doc_id//4+1)*668265263 as w3
 from documents)"""


def forensic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image measurements derived from line items."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("entity_id"),
        F.col("l_quantity").cast("double").alias("ela_std"),
        F.round(F.col("l_discount") * 2.5, 6).alias("bright_ratio"),
        (F.col("l_quantity") * 8).cast("double").alias("max_gradient"),
        F.round(1 + F.col("l_tax") * 10, 6).alias("noise_ratio"),
        (F.col("l_partkey") % 1000).alias("red_count"),
        (F.col("l_suppkey") * 10).cast("double").alias("color_variance"),
    )


METRICS_SQL = """metrics as (select l_orderkey * 8 + l_linenumber as entity_id, cast(l_quantity as double) as ela_std,
 round(l_discount * 2.5, 6) as bright_ratio, cast(l_quantity * 8 as double) as max_gradient, round(1 + l_tax * 10, 6) as noise_ratio,
 l_partkey % 1000 as red_count, cast(l_suppkey * 10 as double) as color_variance from lineitem)"""
