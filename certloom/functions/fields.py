"""Fields of a credential from recognised text: patterns in order, first find wins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from certloom.functions.numerals import CN, cn_date, cn_year

# Patterns of the fields, each with the group that holds the value. "flat"
# patterns are for the text without line breaks, "cn" values are years in Chinese digits.
# (?U) makes \s and \d cover full-width forms.
YEAR = "((19|20)\\d{2})"
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "grad_year": [("", f"(?:毕业|结业|肄业)[^\\d]{{0,12}}{YEAR}"), ("cn", f"([{CN}]{{4}})年[^\\n]{{0,5}}?(?:毕业|结业)"), ("flat cn", f"至([{CN}]{{4}})年")],
    "enrollment_year": [("", f"(?:入学|招生|录取|入读)[^\\d]{{0,12}}{YEAR}"), ("flat cn", f"于([{CN}]{{4}})年")],
    "issue_year": [
        ("", f"(?:发证|颁发|签发|此证|日期)[^\\d]{{0,12}}{YEAR}"),
        ("cn", f"([{CN}]{{4}})年[^\\d]{{0,10}}(?:发证|颁发|签发)"),
        ("cn", f"([{CN}]{{4}})年[^\\n]*日"),
    ],
    "gender": [("", "性别[：:\\s]*(男)"), ("", "性别[：:\\s]*(女)")],
    "cert_no": [("", "(?:证书编号|学历编号|编号)[：:\\s]*([A-Za-z0-9\\-]{6,25})")],
    "school": [("", "([^\\n\\r\\s，。、]{2,20}(?:大学|学院|学校|中学|职业技术学院|职业学院|技术学院))")],
    "principal": [("", "(?:校长|院长)[：:\\s]*([^\\n\\s，。]{2,6})")],
    "cert_type": [("", "(毕业证书|学位证书|结业证书|肄业证书|在读证明|学历证书)")],
    "student_name": [("", "学生\\s*([^\\s性别男女，,。\\d]{2,5})\\s*性别"), ("", "兹证明\\s*([^\\s，,。]{2,5})\\s*(?:同学|同志)")],
    "student_id_no": [("", "学籍号(?:码)?[：:]\\s*(\\d{8,20})")],
    "department": [("", "在本校\\s*([^\\s，,。]{2,20})\\s*学习"), ("", "([^\\s，,。\\n]{2,15}(?:学院|系|学部|专业|学科))")],
    "supervisor": [("", "([^\\n\\s，,。]{4,20})监制")],
}
ID_NUMBER = "\\d{17}[\\dXx]"
BIRTH = [("", f"出生[：:\\s]*{YEAR}"), ("flat cn", f"(?:生于|出生)([{CN}]{{4}})年")]


#: What a text must hold for a pattern to find anything: its fixed words.
WORDS: dict[str, list[str]] = {
    "grad_year": ["毕业|结业|肄业", "毕业|结业", "至"],
    "enrollment_year": ["入学|招生|录取|入读", "于"],
    "issue_year": ["发证|颁发|签发|此证|日期", "发证|颁发|签发", "日"],
    "gender": ["性别", "性别"],
    "cert_no": ["编号"],
    "school": ["大学|学院|学校|中学"],
    "principal": ["校长|院长"],
    "cert_type": ["证书|证明"],
    "student_name": ["性别", "兹证明"],
    "student_id_no": ["学籍号"],
    "department": ["在本校", "学院|系|学部|专业|学科"],
    "supervisor": ["监制"],
}
BIRTH_WORDS = ["出生", "生于|出生"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def holds(text: Column, words: str) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words.split("|")])


def find(text: Column, flat: Column, how: str, pattern: str, words: str) -> Column:
    """What a pattern finds, sought only in texts that hold its words."""
    source = flat if "flat" in how else text
    done = cn_year if "cn" in how else F.trim
    value = bound(F.regexp_extract(source, "(?U)" + pattern, 1), lambda v: F.when(v != "", done(v)))
    return F.when(holds(source, words), value)


def regex_fields(text: Column) -> dict[str, Column]:
    """An expression for each of the 14 fields; of a field's patterns those after the
    first that finds something aren't tried."""
    flat = F.replace(text, F.lit("\n"), F.lit(""))
    out = {name: F.coalesce(*[find(text, flat, how, p, w) for (how, p), w in zip(patterns, WORDS[name])]) for name, patterns in PATTERNS.items()}
    number = bound(F.regexp_extract(text, "(?U)" + ID_NUMBER, 0), lambda v: F.when(v != "", F.substring(v, 7, 4)))
    out["birth_year"] = F.coalesce(number, *[find(text, flat, how, p, w) for (how, p), w in zip(BIRTH, BIRTH_WORDS)])
    out["issue_date"] = F.coalesce(F.when(holds(flat, "日|号"), cn_date(flat)), out["issue_year"])
    return out
