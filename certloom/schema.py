"""Schemas of the stored tables and of the records that the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

from certloom.config import SETTINGS

_long, _string, _bool, _double, _int, _time = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.IntegerType(), T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ISSUE = _struct(rule=_string, detail=_string, severity=_string, related_ids=T.ArrayType(_long))
REGION = _struct(description=_string, reason=_string)
CERTIFICATES = _struct(id=_long, filename=_string, has_face=_bool, upload_time=_time)
OCR_RESULTS = T.StructType([T.StructField("entity_id", _long), *[T.StructField(f, _string) for f in SETTINGS.fields], T.StructField("raw_text", _string), T.StructField("created_at", _time)])
FORENSIC_RESULTS = _struct(
    entity_id=_long, ela_std=_double, ela_suspicious=_bool, photo_edge_suspicious=_bool, has_red_seal=_bool, seal_printed=_bool, risk_level=_string, risk_flags=T.ArrayType(_string), created_at=_time
)
RUNS = _struct(run_id=_long, total_certs=_long, ocr_success=_long, issue_count=_long, high_severity_count=_long, message=_string, created_at=_time)
PS_RESULTS = _struct(
    entity_id=_long,
    overall_authenticity=_string,
    risk_level=_string,
    tampering_probability=_double,
    confidence=_double,
    key_evidence=T.ArrayType(_string),
    no_tampering_evidence=T.ArrayType(_string),
    suspect_regions=T.ArrayType(REGION),
    recommendation=_string,
    raw_response=_string,
    created_at=_time,
)
FRAUD_ISSUES = _struct(run_id=_long, entity_id=_long, rule_name=_string, detail=_string, severity=_string, related_ids=T.ArrayType(_long), issue_type=_string, created_at=_time)
VECTORS = _struct(entity_id=_long, vector_field=_string, vector=T.ArrayType(T.FloatType()))

TABLES = {
    "certificates": CERTIFICATES,
    "ocr_results": OCR_RESULTS,
    "forensic_results": FORENSIC_RESULTS,
    "cross_validate_runs": RUNS,
    "ps_detection_results": PS_RESULTS,
    "fraud_issues": FRAUD_ISSUES,
    "vectors": VECTORS,
}
