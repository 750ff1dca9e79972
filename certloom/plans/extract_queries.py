"""Queries that extract fields from the recognised text of the credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.config import SETTINGS
from certloom.functions import fields, model_json, numerals
from certloom.sources.records import CREDENTIALS_SQL, credentials, ocr_texts


def extract_regex_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fields.regex_fields(F.col("ocr_text"))
    return ocr_texts(spark, sf_dir).select("entity_id", *[found[name].alias(name) for name in SETTINGS.fields])


def parse_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ocr_texts(spark, sf_dir).select("entity_id", model_json.parsed_fields(F.col("ocr_text")).alias("found"))
    return found.select("entity_id", *[F.col(f"found.{name}").alias(name) for name in SETTINGS.fields])


def cn_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of the credentials written in Chinese digits and read again."""
    written = F.translate("grad_year", "0123456789", "〇一二三四五六七八九")
    return credentials(spark, sf_dir).select("entity_id", written.alias("written"), numerals.cn_year(written).alias("year"))


_DAYS = "一 二 三 四 五 六 七 八 九 十 十一 十二 十五 十九 二十 廿 廿一 廿九 卅 卅一".split()


def cn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.translate("grad_year", "0123456789", "〇一二三四五六七八九")
    days = F.array(*map(F.lit, _DAYS))
    month, day = F.element_at(days, (F.col("entity_id") % 12 + 1).cast("int")), F.element_at(days, (F.col("entity_id") % len(_DAYS) + 1).cast("int"))
    text = F.concat(written, F.lit("年"), month, F.lit("月"), day, F.when(F.col("entity_id") % 10 == 3, "").otherwise("日"))
    return credentials(spark, sf_dir).select("entity_id", text.alias("written"), numerals.cn_date(text).alias("issue_date"))


def ps_result_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tampering assessment of the records that carry JSON."""
    json = model_json.unfenced(F.col("ocr_text"))
    found = model_json.assessment(json)
    return (
        ocr_texts(spark, sf_dir)
        .where(model_json.readable_json(json))
        .select("entity_id", found["overall_authenticity"].alias("overall_authenticity"), found["risk_level"].alias("risk_level"), found["confidence"].alias("confidence"), F.size(found["key_evidence"]).alias("n_evidence"))
    )


def envelope_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts inside the four shapes of response."""
    c = credentials(spark, sf_dir).select("entity_id", "school")
    kind = F.col("entity_id") % 4
    response = (
        F.when(kind == 0, F.concat(F.lit('{"choices":[{"message":{"content":"'), "school", F.lit('"}}]}')))
        .when(kind == 1, F.concat(F.lit('{"data":{"content":"  ","text":"'), "school", F.lit('"}}')))
        .when(kind == 2, F.concat(F.lit('{"output":"'), "school", F.lit('"}')))
        .otherwise(F.lit('{"error":1}'))
    )
    return c.select("entity_id", model_json.envelope_text(response).alias("text"))


QUERIES = {f.__name__: f for f in (extract_regex_fields, parse_json_fields, cn_year, cn_date, ps_result_parse, envelope_text)}

_WRITTEN = "translate(grad_year, '0123456789', '〇一二三四五六七八九')"
_MODERN, _OLD = "entity_id % 4 = 0", "entity_id % 4 = 1"
_YEAR = "case when grad_year <> 'N/A' then grad_year end"


def _said(modern: str, old: str, json: str = "null") -> str:
    return f"case when {_MODERN} then {modern} when {_OLD} then {old} else {json} end"


_BORN = "cast(cast(enrollment_year as int) - 18 as varchar)"

#: What the texts say, by construction: patterns and JSON keys have to find it again. An
#: empty value lets a pattern reach the next one, as in the modern layout.
_FIELDS = {
    "cert_type": _said("'毕业证书'", "null"),
    "student_name": _said("case when entity_id % 12 = 8 then '王小明' else '张三丰' end", "'李四光'"),
    "school": "school",
    "department": _said("null", "'历史系'"),
    "principal": _said("coalesce(substr(principal, 1, 6), 'NATION')", "null", "principal"),
    "grad_year": _said(f"coalesce({_YEAR}, enrollment_year)", _YEAR, "grad_year"),
    "enrollment_year": "enrollment_year",
    "issue_year": _said("null", "issue_year"),
    "issue_date": _said("null", "issue_year||'-07-20'"),
    "cert_no": "cert_no",
    "student_id_no": _said("case when entity_id % 12 = 4 then lpad(cast(entity_id as varchar), 12, '2') end", "null"),
    "gender": "gender",
    "birth_year": _said(f"case when entity_id % 16 in (0, 4) then {_BORN} end", f"case when entity_id % 8 = 1 then {_BORN} end"),
    "supervisor": _said("case when entity_id % 12 = 0 then '河北省教育厅' end", "null"),
}
_ALL_FIELDS = ", ".join(f"{sql} as {name}" for name, sql in _FIELDS.items())
_IN_JSON = """'{"school":"' || school"""
#: Patterns find nothing in the JSON layouts but a school, with the key before it.
_BY_PATTERN = ", ".join(f"case when entity_id % 4 < 2 then {sql} else {_IN_JSON if name == 'school' else 'null'} end as {name}" for name, sql in _FIELDS.items())
_DAY_SQL = "[" + ",".join(f"'{d}'" for d in _DAYS) + "]"
_NUMBERS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12, "十五": 15, "十九": 19, "二十": 20, "廿": 20, "廿一": 21, "廿九": 29, "卅": 30, "卅一": 31}
_VALUE_SQL = "[" + ",".join(str(_NUMBERS[d]) for d in _DAYS) + "]"

SQL = {
    "extract_regex_fields": f"with {CREDENTIALS_SQL} select entity_id, {_BY_PATTERN} from certs",
    "parse_json_fields": f"with {CREDENTIALS_SQL} select entity_id, {_ALL_FIELDS} from certs",
    "cn_year": f"with {CREDENTIALS_SQL} select entity_id, {_WRITTEN} as written, case when grad_year <> 'N/A' then grad_year end as year from certs",
    "cn_date": f"""with {CREDENTIALS_SQL} select entity_id, {_WRITTEN}||'年'||{_DAY_SQL}[entity_id % 12 + 1]||'月'||{_DAY_SQL}[entity_id % {len(_DAYS)} + 1]||case when entity_id % 10 = 3 then '' else '日' end as written,
 case when grad_year <> 'N/A' and entity_id % 10 <> 3 then grad_year||'-'||lpad(cast({_VALUE_SQL}[entity_id % 12 + 1] as varchar), 2, '0')||'-'||lpad(cast({_VALUE_SQL}[entity_id % {len(_DAYS)} + 1] as varchar), 2, '0') end as issue_date from certs""",
    "ps_result_parse": f"""with {CREDENTIALS_SQL} select entity_id, coalesce(['高度疑似PS', '疑似修改', '几乎确定伪造', '真实', null][(entity_id // 4) % 5 + 1], '真实') as overall_authenticity,
 ['高', '中', '高', '低', '低'][(entity_id // 4) % 5 + 1] as risk_level, cast(entity_id % 100 as double) as confidence, cast(case entity_id % 3 when 0 then 2 when 1 then 1 else 0 end as int) as n_evidence from certs where entity_id % 4 >= 2""",
    "envelope_text": f"with {CREDENTIALS_SQL} select entity_id, case when entity_id % 4 < 3 then school end as text from certs",
}
