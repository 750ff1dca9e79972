import pytest
from pyspark.sql import functions as F

from certloom.functions import model_json, numerals
from certloom.functions.fields import regex_fields


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("二○一八", "2018"), ("一九九", None), ("1九9四", "1994"), ("", None)])
def test_year(spark, text, want):
    assert one(spark, numerals.cn_year(F.col("t")), text) == want


@pytest.mark.parametrize("text,want", [("廿", 20), ("廿五", 25), ("卅一", 31), ("十", 10), ("十二", 12), ("二十", 20), ("三十一", 31), ("二五", 2), ("", None), ("x", None)])
def test_number(spark, text, want):
    assert one(spark, numerals.cn_number(F.col("t")), text) == want


@pytest.mark.parametrize("text,want", [("一九九四年七月廿日", "1994-07-20"), ("一九九四年七月", None), ("二〇〇一年十二月三十一号", "2001-12-31")])
def test_date(spark, text, want):
    assert one(spark, numerals.cn_date(F.col("t")), text) == want


def fields(spark, text):
    found = regex_fields(F.col("t"))
    return spark.createDataFrame([(text,)], "t string").select(*[v.alias(k) for k, v in found.items()]).first().asDict()


def test_fields_over_lines_and_widths(spark):
    got = fields(spark, "兹证明 王小明 同学\n于一九七二年入校 至一九\n七六年毕业\n性别：　男\n身份证 110101195501012345\n学籍号码：20010001")
    assert got["grad_year"] == "1976" and got["enrollment_year"] == "1972"
    assert got["gender"] == "男" and got["birth_year"] == "1955" and got["student_id_no"] == "20010001" and got["student_name"] == "王小明"


def parsed(spark, text):
    json = model_json.unfenced(F.col("t"))
    more = {f"ps_{k}": v for k, v in model_json.assessment(json).items()} | {"structured": model_json.readable_json(json)}
    row = spark.createDataFrame([(text,)], "t string").select(model_json.parsed_fields(F.col("t")).alias("_fields"), *[v.alias(k) for k, v in more.items()]).first()
    return row.asDict() | row["_fields"].asDict()


def test_json_fields(spark):
    got = parsed(spark, '```json\n{"school":" null ","grad_year":2018,"ps_overall_authenticity":"高度疑似PS","ps_confidence":"85"}\n```')
    assert got["structured"] and got["school"] is None and got["grad_year"] == "2018"
    assert got["ps_risk_level"] == "高" and got["ps_confidence"] == 85.0


def test_unreadable_scores_and_broken_json_fall_back(spark):
    assert not parsed(spark, '{"ps_confidence":"high"}')["structured"]
    got = parsed(spark, '{"school": 北方大学')
    assert not got["structured"] and got["school"] is not None


@pytest.mark.parametrize("value,want", [('{"ps_key_evidence":"x"}', ["x"]), ('{"ps_key_evidence":["a",null,""]}', ["a"]), ('{"ps_key_evidence":5}', []), ("{}", []), ('{"ps_key_evidence":[true, false, 0.00, -0, 2, "b"]}', ["True", "2", "b"])])
def test_lists(spark, value, want):
    assert parsed(spark, value)["ps_key_evidence"] == want


def test_regions(spark):
    got = parsed(spark, '{"ps_suspect_regions":[{"description":"a","reason":"b"},"c"]}')["ps_suspect_regions"]
    assert [tuple(r) for r in got] == [("a", "b"), ("c", "")]


@pytest.mark.parametrize("value,want", [('{"choices":[{"message":{"content":"a"}}],"text":"b"}', "a"), ('{"data":{"content":" ","result":"c"}}', "c"), ('{"output":"d"}', "d"), ("oops", None)])
def test_envelopes(spark, value, want):
    assert one(spark, model_json.envelope_text(F.col("t")), value) == want


def test_texts_of_one_row_group_are_dealt_to_all(spark, tmp_path):
    """A file of one row group is split into many parts, of which one has all rows."""
    from certloom.sources.records import ocr_texts

    rows = {"orders": ("id as o_orderkey, id % 50 as o_custkey", 5_000), "customer": ("id as c_custkey, id % 5 as c_nationkey", 50), "nation": ("id as n_nationkey, string(id) as n_name", 5)}
    for name, (columns, n) in rows.items():
        spark.range(n).selectExpr(*columns.split(", ")).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    known = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in known:
            spark.conf.set(k, "1024")
        counts = [r["count"] for r in ocr_texts(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)
    assert sum(counts) == 5_000 and max(counts) < 1_000
