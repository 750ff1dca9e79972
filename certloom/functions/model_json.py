"""Structured answers of a model: envelopes, code fences, fields and assessments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from certloom.config import SETTINGS
from certloom.functions.fields import bound, regex_fields

# The risk of each verdict on authenticity.
AUTHENTIC = "真实"
VERDICTS = {"真实": "低", "疑似修改": "中", "高度疑似PS": "高", "几乎确定伪造": "高"}
# Places of the text in a response, in order.
ENVELOPES = ("$.choices[0].message.content", "$.data.content", "$.data.text", "$.data.result", "$.data.output", "$.content", "$.text", "$.result", "$.output")


def envelope_text(response: Column) -> Column:
    """The text of a response: the first of the known places that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(response, path)), F.lit("")) for path in ENVELOPES])


def unfenced(text: Column) -> Column:
    """Without a code fence around, and without the model's thoughts."""
    plain = F.regexp_replace(text, "(?is)<thinking>.*?</thinking>", "")
    return F.trim(F.regexp_replace(F.trim(plain), r"(?m)^```(?:json)?\s*|\s*```$", ""))


def clean(value: Column) -> Column:
    """Trimmed; blank, null and none become null."""
    v = F.trim(value)
    return F.when(~F.lower(v).isin("", "null", "none"), v)


def json_value(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def is_object(json: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT"), F.lit(False))


def string_list(json: Column, key: str) -> Column:
    """A list of strings at a key: a list without its empty items (null, "", 0, false and
    empty lists and objects), one string that is not empty as a list, else none."""
    none = F.array().cast("array<string>")
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))

    def text(x: Column) -> Column:
        """As text; true is spelled True."""
        spelled = F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))
        return F.when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(spelled)).otherwise(spelled)

    def given(x: Column) -> Column:
        is_text, number = F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "double")
        return F.coalesce(F.when(is_text, text(x) != "").otherwise(~text(x).isin("False", "[]", "{}", "null") & ((F.schema_of_variant(x) == "BOOLEAN") | number.isNull() | (number != 0))), F.lit(False))

    return F.when(kind.startswith("ARRAY"), F.transform(F.filter(items, given), text)).when((kind == "STRING") & (text(value) != ""), F.array(text(value))).otherwise(none)


def regions(value: Column) -> Column:
    """Suspect regions: objects as they are, scalars as a description without a reason."""
    items = F.filter(F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.transform(
        items,
        lambda x: F.when(x.startswith("{"), F.struct(F.get_json_object(x, "$.description").alias("description"), F.get_json_object(x, "$.reason").alias("reason"))).otherwise(
            F.struct(x.alias("description"), F.lit("").alias("reason"))
        ),
    )


def verdict(value: Column) -> Column:
    return F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit(AUTHENTIC)))


def risk(authenticity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, authenticity), F.lit("低"))


def assessment(json: Column, prefix: str = "ps_") -> dict[str, Column]:
    """The tampering assessment in a JSON object, by column of its table."""
    value = lambda key: json_value(json, prefix + key)
    authenticity = verdict(value("overall_authenticity"))
    return {
        "overall_authenticity": authenticity,
        "risk_level": risk(authenticity),
        "tampering_probability": value("tampering_probability").try_cast("double"),
        "confidence": value("confidence").try_cast("double"),
        "key_evidence": string_list(json, prefix + "key_evidence"),
        "no_tampering_evidence": string_list(json, prefix + "no_tampering_evidence"),
        "suspect_regions": regions(value("suspect_regions")),
        "recommendation": F.trim(F.coalesce(value("recommendation"), F.lit(""))),
    }


def readable_json(json: Column) -> Column:
    """A JSON object whose scores, where given, are numbers."""
    scores = [json_value(json, f"ps_{k}") for k in ("tampering_probability", "confidence")]
    fine = [bound(s, lambda v: v.isNull() | v.try_cast("double").isNotNull()) for s in scores]
    return is_object(json) & fine[0] & fine[1]


def parsed_fields(text: Column) -> Column:
    """A struct of the 14 fields: from JSON if the text is a readable object, else by
    patterns. The JSON is looked for once, and only where an object may begin."""
    by_pattern = F.struct(*[c.alias(name) for name, c in sorted(regex_fields(text).items())])

    def from_json(json: Column) -> Column:
        values = {name: bound(json_value(json, name), clean).alias(name) for name in SETTINGS.fields}
        return F.when(readable_json(json), F.struct(*[values[name] for name in sorted(values)]))

    return F.coalesce(F.when(F.contains(text, F.lit("{")), bound(unfenced(text), from_json)), by_pattern)
