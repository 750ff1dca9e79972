"""Consistency rules over credential records: five of one record, five across records.

Rules of one record are Column expressions that give a null or an issue struct. Rules
across records are DataFrames of issues (rule, detail, severity, related_ids), each
grouping on its key. Years are strings; what does not read as an integer skips a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.config import SETTINGS, Settings
from certloom.operators.similarity import similar_numbers

HIGH, MIDDLE, LOW = "高", "中", "低"
LIST_SEPARATOR = "、"

# Names of the rules as they are reported.
RULE_NAMES = {
    "duration": "学制年限异常",
    "issue_year": "发证年份早于毕业年份",
    "enroll_age": "入学年龄异常",
    "face_age": "照片年龄异常",
    "gender": "性别与照片不符",
    "principal_conflict": "同校同年校长不一致",
    "shared_principal": "不同学校校长相同",
    "tenure": "校长任期异常",
    "duplicate_number": "证书编号重复",
    "similar_number": "证书编号高度相似",
}


def given(column: str | Column) -> Column:
    """Neither null nor empty."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & (c != "")


def as_int(column: str) -> Column:
    """The integer that a string of digits stands for, full-width ones too, else null."""
    digits = F.translate(F.trim(F.col(column)), "０１２３４５６７８９", "0123456789")
    return F.when(digits.rlike(r"^[+-]?[0-9]+$"), digits.try_cast("int"))


def issue(rule: str, detail: Column, severity: Column | str, ids: Column | None = None) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    ids = F.array().cast("array<bigint>") if ids is None else ids
    return F.struct(F.lit(RULE_NAMES[rule]).alias("rule"), detail.alias("detail"), severity.alias("severity"), ids.alias("related_ids"))


def duration_issue(s: Settings = SETTINGS) -> Column:
    years = as_int("grad_year") - as_int("enrollment_year")
    allowed = "[" + ", ".join(map(str, sorted(s.study_durations))) + "]"
    detail = F.concat(F.lit("入学 "), "enrollment_year", F.lit(" 至毕业 "), "grad_year", F.lit("，共 "), years.cast("string"), F.lit(f" 年，不在合理范围 {allowed}"))
    return F.when(~years.isin(*s.study_durations), issue("duration", detail, F.when(years < 0, HIGH).otherwise(MIDDLE)))


def issue_year_issue() -> Column:
    detail = F.concat(F.lit("发证年份 "), "issue_year", F.lit(" < 毕业年份 "), "grad_year")
    return F.when(as_int("issue_year") < as_int("grad_year"), issue("issue_year", detail, HIGH))


def enroll_age_issue(s: Settings = SETTINGS) -> Column:
    age = as_int("enrollment_year") - as_int("birth_year")
    detail = F.concat(
        F.lit("出生年份 "), "birth_year", F.lit("，入学 "), "enrollment_year", F.lit("，入学时年龄 "), age.cast("string"), F.lit(f" 岁（合理范围 {s.min_enrollment_age}-{s.max_enrollment_age}）")
    )
    return F.when(~age.between(s.min_enrollment_age, s.max_enrollment_age), issue("enroll_age", detail, HIGH))


def face_age_issue(s: Settings = SETTINGS) -> Column:
    """An age of 0 counts as none; fractions are cut off."""
    age = F.col("face_age").cast("int")
    detail = F.concat(F.lit("人脸年龄估计 "), age.cast("string"), F.lit(f" 岁，超出在校生合理范围（{s.min_face_age}-{s.max_face_age}岁）"))
    return F.when((F.col("face_age") != 0) & ~age.between(s.min_face_age, s.max_face_age), issue("face_age", detail, MIDDLE))


def face_gender(column: str = "face_gender") -> Column:
    """男 or 女 of a face's gender: a number (0.5 or more is 男) or M, MALE, 1."""
    c = F.col(column).cast("string")
    number = c.try_cast("double")
    return F.when(c.isNull(), None).when(number.isNotNull(), F.when(number >= 0.5, "男").otherwise("女")).otherwise(F.when(F.upper(c).isin("M", "MALE"), "男").otherwise("女"))


def gender_issue() -> Column:
    face = face_gender()
    detail = F.concat(F.lit("证件标注性别【"), "gender", F.lit("】，人脸识别判断为【"), face, F.lit("】"))
    return F.when(given("gender") & (face != F.col("gender")), issue("gender", detail, HIGH))


def record_issues(s: Settings = SETTINGS, with_face: bool = True) -> Column:
    """All issues of one record, in the order of the rules."""
    found = [duration_issue(s), issue_year_issue(), enroll_age_issue(s), *([face_age_issue(s), gender_issue()] if with_face else [])]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def single_issues(records: DataFrame, s: Settings = SETTINGS, with_face: bool = True) -> DataFrame:
    """(entity_id, rule, detail, severity) of the record rules; one scan, no shuffle."""
    return records.select("entity_id", F.explode(record_issues(s, with_face)).alias("i")).select("entity_id", "i.rule", "i.detail", "i.severity")


def readable(records: DataFrame) -> DataFrame:
    """Records whose recognition did not fail."""
    return records.where(~F.coalesce(F.col("ocr_error"), F.lit(False)))


def _names(column: str) -> Column:
    return F.array_sort(F.collect_set(F.when(given(column), F.col(column))))


def _ids() -> Column:
    return F.array_sort(F.collect_list("entity_id"))


def _issues(found: DataFrame, keys: list[str], struct: Column) -> DataFrame:
    return found.select(*keys, struct.alias("_i")).select(*keys, "_i.rule", "_i.detail", "_i.severity", "_i.related_ids")


def principal_conflicts(records: DataFrame) -> DataFrame:
    """Graduates of one school and year whose principals differ; all of them are related."""
    found = readable(records).where(given("school") & given("grad_year")).groupBy("school", "grad_year").agg(_names("principal").alias("names"), _ids().alias("ids")).where(F.size("names") > 1)
    detail = F.concat(F.lit("【"), "school", F.lit("】"), "grad_year", F.lit("年毕业证出现 "), F.size("names").cast("string"), F.lit(" 个不同校长："), F.array_join("names", LIST_SEPARATOR))
    return _issues(found, ["school", "grad_year"], issue("principal_conflict", detail, HIGH, F.col("ids")))


def shared_principals(records: DataFrame) -> DataFrame:
    """Principals of more than one school."""
    found = readable(records).where(given("principal")).groupBy("principal").agg(_names("school").alias("names"), _ids().alias("ids")).where(F.size("names") > 1)
    detail = F.concat(F.lit("校长『"), "principal", F.lit("』出现在 "), F.size("names").cast("string"), F.lit(" 所不同学校："), F.array_join("names", LIST_SEPARATOR))
    return _issues(found, ["principal"], issue("shared_principal", detail, HIGH, F.col("ids")))


def long_tenures(records: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Principals of a school over more years than allowed; no records are related."""
    year = as_int("grad_year")
    found = (
        readable(records)
        .where(given("school") & given("principal") & year.isNotNull())
        .groupBy("school", "principal")
        .agg(F.min(year).alias("first"), F.max(year).alias("last"), F.count(F.lit(1)).alias("n"))
        .withColumn("tenure", F.col("last") - F.col("first") + 1)
        .where((F.col("n") >= 2) & (F.col("tenure") > s.max_tenure))
    )
    detail = F.concat(
        F.lit("【"), "school", F.lit("】校长『"), "principal", F.lit("』任期跨度 "), F.col("tenure").cast("string"), F.lit(" 年（"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"),
        F.lit(f"），超过 {s.max_tenure} 年"),
    )
    return _issues(found, ["school", "principal"], issue("tenure", detail, MIDDLE))


def duplicate_numbers(records: DataFrame) -> DataFrame:
    """Certificate numbers of more than one record."""
    found = readable(records).where(given("cert_no")).groupBy("cert_no").agg(_ids().alias("ids")).where(F.size("ids") > 1)
    detail = F.concat(F.lit("证书编号『"), "cert_no", F.lit("』被 "), F.size("ids").cast("string"), F.lit(" 人共用："), F.array_join(F.col("ids").cast("array<string>"), LIST_SEPARATOR))
    return _issues(found, ["cert_no"], issue("duplicate_number", detail, HIGH, F.col("ids")))


def similar_number_issues(records: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Records whose certificate numbers differ but are alike."""
    pairs = similar_numbers(readable(records).where(given("cert_no")).select("entity_id", "cert_no"), s.number_similarity)
    detail = F.concat(
        F.lit("ID "), F.col("id1").cast("string"), F.lit(" 编号『"), "no1", F.lit("』与 ID "), F.col("id2").cast("string"), F.lit(" 编号『"), "no2", F.lit("』相似度 "), F.round(F.col("similarity") * 100, 1).cast("string"), F.lit("%")
    )
    return _issues(pairs, ["id1", "id2", "similarity"], issue("similar_number", detail, HIGH, F.array("id1", "id2")))


def cross_issues(records: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Issues of all rules across records."""
    found = [principal_conflicts(records), shared_principals(records), long_tenures(records, s), duplicate_numbers(records), similar_number_issues(records, s)]
    columns = ["rule", "detail", "severity", "related_ids"]
    out = found[0].select(*columns)
    for more in found[1:]:
        out = out.unionByName(more.select(*columns))
    return out


def risk_level(issues: Column, flags: Column) -> Column:
    """高 with an issue of that severity or two forensic flags, 中 with any, else 低."""
    severe = F.exists(issues, lambda i: i["severity"] == HIGH)
    return F.when(severe | (F.size(flags) >= 2), HIGH).when((F.size(issues) > 0) | (F.size(flags) > 0), MIDDLE).otherwise(LOW)


def forensic_level(flags: Column) -> Column:
    return F.when(F.size(flags) >= 2, HIGH).when(F.size(flags) == 1, MIDDLE).otherwise(LOW)


def forensic_flags() -> Column:
    """Names of the measurements that are suspicious, in their order."""
    ela = (F.col("ela_std") > 45) | (F.col("bright_ratio") > 0.20) | ((F.col("ela_std") > 25) & (F.col("bright_ratio") > 0.10))
    edge = (F.col("max_gradient") > 200) & (F.col("noise_ratio") > 1.5)
    printed = (F.col("red_count") >= 200) & (F.col("color_variance") < 600)
    # The texts of the flags
    flags = F.array(F.when(ela, "ELA检测到可疑修改区域"), F.when(edge, "照片边缘异常锐利，疑似贴片"), F.when(printed, "印章疑似打印，非实体盖章"))
    return F.filter(flags, lambda x: x.isNotNull())
