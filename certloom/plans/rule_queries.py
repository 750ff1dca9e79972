"""Queries of the consistency rules over the credential records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.operators import rules, similarity
from certloom.plans.audit import all_issues, batch_analyze, batch_events, batch_result, run_header
from certloom.sources.records import CREDENTIALS_SQL, FACES_SQL, HASHES_SQL, METRICS_SQL, credentials, faces, forensic_metrics, region_hashes

CERTS = f"with {CREDENTIALS_SQL}"
WITH_FACES = f"{CERTS}, {FACES_SQL}"

_INT = "(case when regexp_full_match(trim({c}), '[+-]?[0-9]+') then try_cast(trim({c}) as int) end)"


def as_int(column: str) -> str:
    return _INT.format(c=column)


def _one(records: DataFrame, issue) -> DataFrame:
    return records.select("entity_id", issue.alias("i")).where("i is not null").select("entity_id", "i.detail", "i.severity")


def rule1_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(credentials(spark, sf_dir), rules.duration_issue())


def rule2_issue_before_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(credentials(spark, sf_dir), rules.issue_year_issue())


def rule3_enroll_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(credentials(spark, sf_dir), rules.enroll_age_issue())


def records_with_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials(spark, sf_dir).join(faces(spark, sf_dir), "entity_id", "left")


def rule4_face_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(records_with_faces(spark, sf_dir), rules.face_age_issue())


def rule5_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(records_with_faces(spark, sf_dir), rules.gender_issue())


def single_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.single_issues(records_with_faces(spark, sf_dir))


def rule6_principal_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.principal_conflicts(credentials(spark, sf_dir))


def rule7_shared_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.shared_principals(credentials(spark, sf_dir))


def rule8_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.long_tenures(credentials(spark, sf_dir))


def rule9_dup_cert_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.duplicate_numbers(credentials(spark, sf_dir))


def rule10_similar_cert_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.similar_number_issues(credentials(spark, sf_dir))


def region_hash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_hashes(region_hashes(spark, sf_dir))


def region_hash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each image its class of equal hashes and how many others are near."""
    return similarity.hash_links(region_hashes(spark, sf_dir)).select("entity_id", F.col("class").alias("class_id"), "n_links")


def forensic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forensic_metrics(spark, sf_dir).withColumn("flags", rules.forensic_flags())
    return found.select("entity_id", F.array_join("flags", ",").alias("risk_flags"), F.size("flags").alias("n_flags"), rules.forensic_level(F.col("flags")).alias("risk_level"))


def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk of every record from its own issues and a forensic result of the same id."""
    metrics = forensic_metrics(spark, sf_dir).select(F.col("entity_id"), rules.forensic_flags().alias("flags"))
    records = records_with_faces(spark, sf_dir).select("entity_id", rules.record_issues().alias("issues")).join(metrics, "entity_id", "left")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return records.select("entity_id", F.size("issues").alias("n_issues"), F.size(flags).alias("n_flags"), rules.risk_level(F.col("issues"), flags).alias("risk_level"))


def cross_validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all rules across records by rule and severity, with the records they relate."""
    issues = rules.cross_issues(credentials(spark, sf_dir))
    return issues.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("issues"), F.sum(F.size("related_ids")).cast("long").alias("related"))


def cross_validate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of a run: records, readable ones, issues and severe ones."""
    records = credentials(spark, sf_dir)
    return run_header(records, all_issues(records)).select("total_certs", "ocr_success", "issue_count", "high_severity_count")


QUERIES = {
    f.__name__: f
    for f in (
        rule1_duration,
        rule2_issue_before_grad,
        rule3_enroll_age,
        rule4_face_age,
        rule5_gender,
        single_issues,
        rule6_principal_conflict,
        rule7_shared_principal,
        rule8_tenure,
        rule9_dup_cert_no,
        rule10_similar_cert_no,
        region_hash_pairs,
        region_hash_links,
        forensic_rollup,
        risk_levels,
        cross_validate_summary,
        cross_validate_run,
        batch_result,
        batch_events,
    )
} | {"batch_analyze_stream": batch_analyze}

_G, _E, _B, _I = (as_int(c) for c in ("grad_year", "enrollment_year", "birth_year", "issue_year"))
_RULE1 = f"""select entity_id, '学制年限异常' as rule, '入学 '||enrollment_year||' 至毕业 '||grad_year||'，共 '||({_G}-{_E})||' 年，不在合理范围 [2, 3, 4, 5]' as detail,
 case when {_G}-{_E} < 0 then '高' else '中' end as severity from certs where {_G}-{_E} not in (2,3,4,5)"""
_RULE2 = f"""select entity_id, '发证年份早于毕业年份' as rule, '发证年份 '||issue_year||' < 毕业年份 '||grad_year as detail, '高' as severity from certs where {_I} < {_G}"""
_RULE3 = f"""select entity_id, '入学年龄异常' as rule, '出生年份 '||birth_year||'，入学 '||enrollment_year||'，入学时年龄 '||({_E}-{_B})||' 岁（合理范围 15-30）' as detail, '高' as severity
 from certs where {_E}-{_B} not between 15 and 30"""
_RULE4 = """select entity_id, '照片年龄异常' as rule, '人脸年龄估计 '||face_age||' 岁，超出在校生合理范围（16-35岁）' as detail, '中' as severity
 from faces where face_age <> 0 and face_age not between 16 and 35"""
_RULE5 = """select entity_id, '性别与照片不符' as rule, '证件标注性别【'||gender||'】，人脸识别判断为【'||case when face_gender='M' then '男' else '女' end||'】' as detail, '高' as severity
 from certs join faces using (entity_id) where gender <> '' and gender <> case when face_gender='M' then '男' else '女' end"""

_CONFLICTS = """select school, grad_year, '同校同年校长不一致' as rule, '【'||school||'】'||grad_year||'年毕业证出现 '||len(names)||' 个不同校长：'||array_to_string(names, '、') as detail, '高' as severity, ids as related_ids
 from (select school, grad_year, list_sort(list(distinct nullif(principal,'')) filter (principal <> '')) as names, list_sort(list(entity_id)) as ids
  from certs where not ocr_error and school <> '' and grad_year <> '' group by all) where len(names) > 1"""
_SHARED = """select principal, '不同学校校长相同' as rule, '校长『'||principal||'』出现在 '||len(names)||' 所不同学校：'||array_to_string(names, '、') as detail, '高' as severity, ids as related_ids
 from (select principal, list_sort(list(distinct school) filter (school <> '')) as names, list_sort(list(entity_id)) as ids
  from certs where not ocr_error and principal <> '' group by all) where len(names) > 1"""
_TENURE = f"""select school, principal, '校长任期异常' as rule, '【'||school||'】校长『'||principal||'』任期跨度 '||(y-x+1)||' 年（'||x||'-'||y||'），超过 12 年' as detail, '中' as severity, cast([] as bigint[]) as related_ids
 from (select school, principal, min({_G}) as x, max({_G}) as y, count(*) as n from certs where not ocr_error and school <> '' and principal <> '' and {_G} is not null group by all)
 where n >= 2 and y-x+1 > 12"""
_DUPLICATES = """select cert_no, '证书编号重复' as rule, '证书编号『'||cert_no||'』被 '||len(ids)||' 人共用：'||array_to_string(ids, '、') as detail, '高' as severity, ids as related_ids
 from (select cert_no, list_sort(list(entity_id)) as ids from certs where not ocr_error and cert_no <> '' group by all) where len(ids) > 1"""
_FLAGS = """array_to_string(list_filter([case when ela_std > 45 or bright_ratio > 0.20 or (ela_std > 25 and bright_ratio > 0.10) then 'ELA检测到可疑修改区域' end,
 case when max_gradient > 200 and noise_ratio > 1.5 then '照片边缘异常锐利，疑似贴片' end, case when red_count >= 200 and color_variance < 600 then '印章疑似打印，非实体盖章' end], lambda x: x is not null), ',')"""
_SINGLE = f"{_RULE1} union all {_RULE2} union all {_RULE3} union all {_RULE4} union all {_RULE5}"

# a record whose recognition failed has no fields, so that only its face can be at fault
_BATCH = f"""{WITH_FACES}, {METRICS_SQL}, s as ({_SINGLE}), i as (select s.entity_id, count(*) as n, bool_or(severity = '高') as severe from s join certs using (entity_id) where not ocr_error or rule = '照片年龄异常' group by 1),
 w as (select entity_id, max(ela_std) as ela_std, max(bright_ratio) as bright_ratio, max(max_gradient) as max_gradient, max(noise_ratio) as noise_ratio, max(red_count) as red_count, min(color_variance) as color_variance from metrics group by 1),
 f as (select entity_id, {_FLAGS} as risk_flags from w), n as (select entity_id, case when risk_flags = '' then 0 else len(risk_flags) - len(replace(risk_flags, ',', '')) + 1 end as n_flags from f),
 c as (select c.entity_id, case when entity_id % 89 = 0 then 'skip' when entity_id % 83 = 0 then 'error' else 'ok' end as status, coalesce(i.n, 0) as n, coalesce(i.severe, false) as severe, coalesce(n.n_flags, 0) as m
  from certs c left join i using (entity_id) left join n using (entity_id)),
 o as (select entity_id, status, case status when 'skip' then 'image not found' when 'error' then 'cannot identify image file' end as error,
  case when status <> 'ok' then null when severe or m >= 2 then '高' when n > 0 or m > 0 then '中' else '低' end as risk_level,
  cast(case when status = 'ok' then n else 0 end as int) as n_issues, cast(case when status = 'ok' then m else 0 end as int) as n_flags from c)"""

SQL = {
    "rule1_duration": f"{CERTS} select entity_id, detail, severity from ({_RULE1})",
    "rule2_issue_before_grad": f"{CERTS} select entity_id, detail, severity from ({_RULE2})",
    "rule3_enroll_age": f"{CERTS} select entity_id, detail, severity from ({_RULE3})",
    "rule4_face_age": f"{WITH_FACES} select entity_id, detail, severity from ({_RULE4})",
    "rule5_gender": f"{WITH_FACES} select entity_id, detail, severity from ({_RULE5})",
    "single_issues": f"{WITH_FACES} {_SINGLE}",
    "rule6_principal_conflict": f"{CERTS} {_CONFLICTS}",
    "rule7_shared_principal": f"{CERTS} {_SHARED}",
    "rule8_tenure": f"{CERTS} {_TENURE}",
    "rule9_dup_cert_no": f"{CERTS} {_DUPLICATES}",
    "region_hash_pairs": f"""with {HASHES_SQL}, d as (select a.entity_id as id1, b.entity_id as id2,
 bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) + bit_count(xor(a.w2, b.w2)) + bit_count(xor(a.w3, b.w3)) as distance from hashes a join hashes b on a.entity_id < b.entity_id)
 select id1, id2, cast(distance as int) as distance from d where distance < 10""",
    "region_hash_links": f"""with {HASHES_SQL}, d as (select a.entity_id as id1, b.entity_id as id2,
 bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) + bit_count(xor(a.w2, b.w2)) + bit_count(xor(a.w3, b.w3)) as distance from hashes a join hashes b on a.entity_id < b.entity_id),
 w as (select id1 as entity_id from d where distance < 10 union all select id2 from d where distance < 10), n as (select entity_id, count(*) as n from w group by 1)
 select h.entity_id, min(h.entity_id) over (partition by w0, w1, w2, w3) as class_id, coalesce(n, 0) as n_links from hashes h left join n using (entity_id)""",
    "forensic_rollup": f"""with {METRICS_SQL}, f as (select entity_id, {_FLAGS} as risk_flags from metrics),
 n as (select *, case when risk_flags = '' then 0 else len(risk_flags) - len(replace(risk_flags, ',', '')) + 1 end as n_flags from f)
 select entity_id, risk_flags, cast(n_flags as int) as n_flags, case when n_flags >= 2 then '高' when n_flags = 1 then '中' else '低' end as risk_level from n""",
    "risk_levels": f"""{WITH_FACES}, {METRICS_SQL}, s as ({_SINGLE}), i as (select entity_id, count(*) as n, bool_or(severity = '高') as severe from s group by 1),
 f as (select entity_id, {_FLAGS} as risk_flags from metrics), n as (select entity_id, case when risk_flags = '' then 0 else len(risk_flags) - len(replace(risk_flags, ',', '')) + 1 end as n_flags from f)
 select c.entity_id, cast(coalesce(i.n, 0) as int) as n_issues, cast(coalesce(n.n_flags, 0) as int) as n_flags,
 case when coalesce(i.severe, false) or coalesce(n.n_flags, 0) >= 2 then '高' when coalesce(i.n, 0) > 0 or coalesce(n.n_flags, 0) > 0 then '中' else '低' end as risk_level
 from certs c left join i using (entity_id) left join n using (entity_id)""",
    **dict.fromkeys(("batch_result", "batch_analyze_stream"), f"{_BATCH} select entity_id, status, error, risk_level, n_issues, n_flags from o"),
    "batch_events": f"""{_BATCH} select row_number() over (order by entity_id) as done, count(*) over () as total, entity_id as id, entity_id||'.png' as filename, status, risk_level, error from o""",
}
