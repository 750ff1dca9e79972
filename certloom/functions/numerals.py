"""Chinese numerals, years and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that stand for a digit in a year, and those digits.
CN_DIGITS, DIGITS = "○〇零一二三四五六七八九", "000123456789"
CN = "一二三四五六七八九○〇零"
_ONES = "一二三四五六七八九"


def cn_year(text: Column) -> Column:
    """Four digits of a year in Chinese or Arabic digits, other characters left out."""
    year = F.regexp_replace(F.translate(text, CN_DIGITS, DIGITS), "[^0-9]", "")
    return F.try_element_at(F.filter(F.array(year), lambda y: F.length(y) == 4), F.lit(1))


def _position(c: Column) -> Column:
    """1 to 9 of the Chinese digit that a text starts with, else 0."""
    first = F.substring(c, 1, 1)
    return F.coalesce(F.try_element_at(F.create_map(*[x for i, d in enumerate(_ONES, 1) for x in (F.lit(d), F.lit(i))]), first), F.lit(0))


def cn_number(text: Column) -> Column:
    """A day or month up to 39: 廿 and 卅 for 20 and 30, 十, x十, x十y, one digit.

    What follows the number is ignored; without a number it is null.
    """
    t = F.trim(text)
    head, rest = F.substring(t, 1, 1), F.substring(t, 2, 10)
    tens = _position(t)
    after_ten = F.substring(t, 3, 10)
    return (
        F.when(F.length(t) == 0, None)
        .when(head == "廿", 20 + _position(rest))
        .when(head == "卅", 30 + _position(rest))
        .when(head == "十", 10 + _position(rest))
        .when((tens > 0) & (F.substring(t, 2, 1) == "十"), tens * 10 + _position(after_ten))
        .when(tens > 0, tens)
        .when(t.rlike("^[0-9]+$"), t.try_cast("int"))
    )


_PART = "[一二三四五六七八九十廿卅]{1,4}"
DATE = f"([{CN}]{{4}})年({_PART})月({_PART})[日号]"


def cn_date(text: Column) -> Column:
    """YYYY-MM-DD of the first date in Chinese numerals with a day, or null.

    The text is searched once; the parts are read from what is found.
    """

    def read(found: Column) -> Column:
        year = cn_year(F.substring(found, 1, 4))
        month, day = cn_number(F.regexp_extract(found, DATE, 2)), cn_number(F.regexp_extract(found, DATE, 3))
        parts = F.filter(F.array(F.struct(year.alias("y"), month.alias("m"), day.alias("d"))), lambda p: p["y"].isNotNull() & (p["m"] > 0) & (p["d"] > 0))
        return F.try_element_at(F.transform(parts, lambda p: F.format_string("%s-%02d-%02d", p["y"], p["m"], p["d"])), F.lit(1))

    return F.element_at(F.transform(F.array(F.regexp_extract(text, DATE, 0)), lambda v: F.when(v != "", read(v))), 1)
