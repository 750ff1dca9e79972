from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from certloom.operators import rules, similarity

COLUMNS = "entity_id long, school string, principal string, grad_year string, enrollment_year string, issue_year string, birth_year string, gender string, cert_no string, ocr_error boolean, face_age double, face_gender string"


def records(spark, *rows):
    base = {"ocr_error": False}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple({**base, "entity_id": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], COLUMNS)


def found(df):
    return sorted((r["entity_id"], r["rule"], r["severity"]) for r in df.collect())


def test_record_rules(spark):
    df = records(
        spark,
        {"grad_year": "2000", "enrollment_year": "2001"},
        {"grad_year": "2010", "enrollment_year": "2001"},
        {"grad_year": "2004", "enrollment_year": "2000", "issue_year": "2003", "birth_year": "1990"},
        {"grad_year": "N/A", "enrollment_year": "2000", "birth_year": ""},
        {"grad_year": "２００４", "enrollment_year": " 2000 "},
        {"face_age": 0.0, "face_gender": "M", "gender": "女"},
        {"face_age": 35.9, "face_gender": "0.5", "gender": "男"},
        {"face_age": 15.0, "face_gender": None, "gender": "男"},
    )
    n = rules.RULE_NAMES
    assert found(rules.single_issues(df)) == sorted(
        [(0, n["duration"], "高"), (1, n["duration"], "中"), (2, n["issue_year"], "高"), (2, n["enroll_age"], "高"), (5, n["gender"], "高"), (7, n["face_age"], "中")]
    )


def test_rules_across_records(spark):
    a = {"school": "A", "principal": "p", "grad_year": "2000", "cert_no": "12345678"}
    df = records(spark, a, a | {"principal": "q"}, a | {"principal": None}, a | {"principal": "r", "ocr_error": True}, a | {"school": "B", "grad_year": "2001", "cert_no": ""}, a | {"grad_year": "2013", "cert_no": "99999999"})
    conflict = rules.principal_conflicts(df).collect()
    assert [(r["school"], r["grad_year"], r["related_ids"]) for r in conflict] == [("A", "2000", [0, 1, 2])]
    assert [(r["principal"], r["related_ids"]) for r in rules.shared_principals(df).collect()] == [("p", [0, 4, 5])]
    tenure = rules.long_tenures(df).collect()
    assert len(tenure) == 1 and tenure[0]["related_ids"] == [] and "14 年" in tenure[0]["detail"]
    assert [(r["cert_no"], r["related_ids"]) for r in rules.duplicate_numbers(df).collect()] == [("12345678", [0, 1, 2])]


def test_risk_levels(spark):
    rows = spark.createDataFrame([(0, [], []), (1, ["中"], []), (2, ["高"], []), (3, [], ["x"]), (4, [], ["x", "y"])], "id long, s array<string>, flags array<string>")
    issues = F.transform("s", lambda x: F.struct(x.alias("severity")))
    assert [r[0] for r in rows.orderBy("id").select(rules.risk_level(issues, F.col("flags"))).collect()] == ["低", "中", "高", "中", "高"]


def brute(numbers, threshold=0.85):
    out = set()
    for (i, a), (j, b) in combinations(sorted(numbers, key=lambda x: (len(x[1]), x[0])), 2):
        if len(b) - len(a) <= len(b) * (1 - threshold) + 1 and a != b and (s := SequenceMatcher(None, a, b).ratio()) >= threshold:
            out.add((i, j, round(s, 6)))
    return out


@pytest.mark.parametrize("lengths", [(6, 10), (11, 15), (18, 24)])
def test_similar_numbers_against_all_pairs(spark, lengths):
    import random

    rng = random.Random(lengths[0])
    numbers = []
    for i in range(120):
        if i % 3 and numbers:
            no = list(rng.choice(numbers)[1])
            for _ in range(rng.choice([1, 1, 2, 3])):
                at = rng.randrange(len(no))
                no[at : at + 1] = rng.choice([[], [rng.choice("0123")], [rng.choice("0123"), no[at]]])
            numbers.append((i, "".join(no) or "0"))
        else:
            numbers.append((i, "".join(rng.choice("0123") for _ in range(rng.randint(*lengths)))))
    df = spark.createDataFrame(numbers, "entity_id long, cert_no string")
    got = {(r["id1"], r["id2"], r["similarity"]) for r in similarity.similar_numbers(df, 0.85).collect()}
    assert got == brute(numbers)


def test_similar_hashes_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(256) for _ in range(6)]
    hashes = []
    for i in range(80):
        h = base[i % 6]
        for _ in range(rng.choice([0, 3, 5, 9, 14])):
            h ^= 1 << rng.randrange(256)
        hashes.append(h)

    def words(h):
        return [int.from_bytes(((h >> (64 * k)) & (2**64 - 1)).to_bytes(8, "big"), "big", signed=True) for k in (3, 2, 1, 0)]

    df = spark.createDataFrame([(i, *words(h)) for i, h in enumerate(hashes)], "entity_id long, w0 long, w1 long, w2 long, w3 long")
    got = {(r["id1"], r["id2"], r["distance"]) for r in similarity.similar_hashes(df).collect()}
    want = {(i, j, d) for i, j in combinations(range(80), 2) if (d := (hashes[i] ^ hashes[j]).bit_count()) < 10}
    assert got == want


@pytest.mark.parametrize("length", [9, 20])
def test_exploded_numbers_are_not_broadcast(spark, length):
    """A short table of numbers has many keys: its files' size must not choose a broadcast."""
    df = spark.range(50).select(F.col("id").alias("entity_id"), F.lpad(F.col("id").cast("string"), length, "0").alias("cert_no"))
    plan = similarity.similar_numbers(df, 0.85)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_similar_numbers_of_few_and_of_many_records(spark):
    """Numbers of one, two, three and more records, among them swapped neighbours, which become
    equal in two ways, and runs: each pair of records once."""
    numbers = ["123456789", "213456789", "123456798", "112233445", "112233454", "121212121", "212121212", "12345678", "1234567890", "111111111", "111111112"]
    rows = [(i, numbers[i % len(numbers)]) for i in range(25)] + [(100 + i, numbers[i]) for i in (0, 0, 5, 9, 10)]
    rows = [(at, no) for at, (_, no) in enumerate(rows)]
    for some in (rows, rows[:20], rows[:11]):
        got = [(r["id1"], r["id2"], r["similarity"]) for r in similarity.similar_numbers(spark.createDataFrame(some, "entity_id long, cert_no string"), 0.85).collect()]
        assert len(got) == len(set(got)) > 5 and set(got) == brute(some)


def test_pairs_of_similar_numbers_meet_once(spark):
    """One join and no grouping or joins of pairs after it, where numbers have few records."""
    df = spark.range(50).select(F.col("id").alias("entity_id"), F.lpad(F.col("id").cast("string"), 9, "0").alias("cert_no"))
    plan = similarity.similar_numbers(df, 0.85)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "Aggregate" not in plan


@pytest.mark.parametrize("alphabet", ["01", "0123456789", "一甲a"])
def test_ratios_are_those_of_difflib(alphabet):
    import random

    import pyarrow as pa

    rng, a, b = random.Random(5), ["", "", "ab" * 120], ["", "x", "ba" * 120]
    for _ in range(2_000):
        no = [rng.choice(alphabet) for _ in range(rng.choice([1, 8, 9, 13, 24]))]
        a.append("".join(no))
        for _ in range(rng.choice([1, 2, 3])):
            at = rng.randrange(len(no) + 1)
            no[at : at + 1] = rng.choice([[], [rng.choice(alphabet)], [rng.choice(alphabet), *no[at : at + 1]]])
        b.append("".join(no))
    for first in (0, 5):  # a slice has an offset
        got = similarity.ratios(*(pa.array(x).slice(first) for x in (a, b, [False] * len(a)))).to_pylist()
        assert got == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a[first:], b[first:])]


def test_percentages_of_similar_numbers(spark):
    """As a format of one decimal place writes them."""
    found = spark.createDataFrame([(x / 400,) for x in range(401)], "similarity double")
    got = found.select(F.round(F.col("similarity") * 100, 1).cast("string").alias("got"), F.format_string("%.1f", F.col("similarity") * 100).alias("want")).where("got <> want")
    assert got.count() == 0
