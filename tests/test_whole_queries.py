"""Registered queries on a small folder, against brute force over its records."""

from collections import defaultdict
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from certloom.plans import audit, extract_queries, ledger_queries, rule_queries
from certloom.sources.records import credentials


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    keys = [*range(1, 31), 49, 50, 99, 100, 113, 194, 291, 10, 3000]
    tables = {
        "orders": ([(k, k % 5) for k in sorted(set(keys))], "o_orderkey long, o_custkey long"),
        "customer": ([(c, c % 3) for c in range(5)], "c_custkey long, c_nationkey long"),
        "nation": ([(n, f"N{n}") for n in range(3)], "n_nationkey long, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def grouped(records, *keys):
    out = defaultdict(list)
    for r in records:
        if all(r[k] for k in keys):
            out[tuple(r[k] for k in keys)].append(r)
    return out.values()


def brute_issues(records):
    """(rule, severity, related records) of the five rules across records."""
    found, good = [], [r for r in records if not r["ocr_error"]]
    found += [("同校同年校长不一致", "高", len(g)) for g in grouped(good, "school", "grad_year") if len({r["principal"] for r in g if r["principal"]}) > 1]
    found += [("不同学校校长相同", "高", len(g)) for g in grouped(good, "principal") if len({r["school"] for r in g}) > 1]
    for g in grouped([r for r in good if r["grad_year"].isdigit()], "school", "principal"):
        years = [int(r["grad_year"]) for r in g]
        found += [("校长任期异常", "中", 0)] * (len(g) > 1 and max(years) - min(years) + 1 > 12)
    found += [("证书编号重复", "高", len(g)) for g in grouped(good, "cert_no") if len(g) > 1]
    for a, b in combinations(sorted(good, key=lambda r: r["entity_id"]), 2):
        x, y = a["cert_no"], b["cert_no"]
        found += [("证书编号高度相似", "高", 2)] * (x != y and SequenceMatcher(None, x, y).ratio() >= 0.85)
    return found


def test_cross_validation_counts_the_issues_of_all_rules(spark, folder):
    records = credentials(spark, folder).collect()
    found = brute_issues(records)
    want = defaultdict(lambda: (0, 0))
    for rule, severity, n in found:
        want[rule, severity] = (want[rule, severity][0] + 1, want[rule, severity][1] + n)
    got = {(r["rule"], r["severity"]): (r["issues"], r["related"]) for r in rule_queries.cross_validate_summary(spark, folder).collect()}
    assert got == want and got["证书编号高度相似", "高"][0] > 0
    header = rule_queries.cross_validate_run(spark, folder).first()
    assert tuple(header) == (len(records), sum(not r["ocr_error"] for r in records), len(found), sum(s == "高" for _, s, _ in found))


def test_patterns_apply_to_every_recognised_text(spark, folder):
    records = credentials(spark, folder).collect()
    rows = {r["entity_id"]: {k: v for k, v in r.asDict().items() if v is not None and k != "entity_id"} for r in extract_queries.extract_regex_fields(spark, folder).collect()}
    assert set(rows) == {r["entity_id"] for r in records}
    for r in records:
        k = r["entity_id"]
        if k % 4 < 2:  # in Chinese: the number is found
            assert rows[k]["cert_no"] == r["cert_no"]
        else:  # JSON has no Chinese keys; the pattern of schools takes up to 20 characters
            assert rows[k] == {"school": ('{"school":"' + r["school"].removesuffix("大学"))[-20:] + "大学"}


def test_a_whole_header_writes_no_table_of_issues(spark, folder, monkeypatch):
    """Of three regions of 30 images and all rules; what is counted needs no texts and no table."""
    spark.range(30).withColumnRenamed("id", "doc_id").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    regions = ledger_queries.cross_validate_regions(spark, folder).count()
    found = brute_issues(credentials(spark, folder).collect())
    monkeypatch.setattr(audit, "cut", None)
    header = ledger_queries.cross_validate_whole(spark, folder).first()
    assert regions > 0 and header["issue_count"] == len(found) + regions and header["high_severity_count"] == header["issue_count"] - sum(s == "中" for _, s, _ in found)
