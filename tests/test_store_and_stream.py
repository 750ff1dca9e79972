import pandas as pd
import pytest
from pyspark.sql import functions as F

from certloom.plans.audit import batch_records
from certloom.sources import ingest, store as stored
from certloom.sources.store import Store
from certloom.streaming.audit_stream import audited, batch_analyze, batch_analyze_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    made.create()
    return made


def ocr(spark, *rows):
    return spark.createDataFrame(rows, "entity_id long, school string").withColumn("created_at", F.current_timestamp())


def schools(store, version=None):
    return sorted(r["school"] for r in store.read("ocr_results", version).collect())


def test_a_failed_commit_changes_nothing(spark, store, tmp_path):
    """Of two tables the second can't be written: neither has changed, nothing is left behind."""
    store.append("ocr_results", ocr(spark, (1, "A")))
    before = store.version()
    broken = spark.range(1).select(F.col("id").alias("entity_id"), F.raise_error(F.lit("lost")).cast("string").alias("risk_level"))
    with pytest.raises(Exception, match="lost"):
        store.commit(added={"ocr_results": ocr(spark, (2, "B")), "forensic_results": broken})
    assert store.version() == before and schools(store) == ["A"]
    assert len(list((tmp_path / "store" / "ocr_results").iterdir())) == 1
    with pytest.raises(Exception, match="lost"):
        store.replace("forensic_results", broken)
    assert store.read("forensic_results").count() == 0


def test_a_version_that_was_not_finished_is_not_read(spark, store, tmp_path):
    store.append("ocr_results", ocr(spark, (1, "A")))
    (tmp_path / "store" / "versions" / f"{store.version() + 1:012d}").write_text('{"tables": {"ocr_')
    assert schools(Store(spark, store.folder)) == ["A"]
    store.append("ocr_results", ocr(spark, (2, "B")))
    assert schools(store) == ["A", "B"]


def test_readers_keep_a_version(spark, store):
    store.append("ocr_results", ocr(spark, (1, "A")))
    held, version = store.read("ocr_results"), store.version()
    store.replace("ocr_results", store.read("ocr_results").withColumn("school", F.lit("B")))
    assert [r["school"] for r in held.collect()] == ["A"] == schools(store, version) and schools(store) == ["B"]
    store.clean(keep=1)
    assert schools(store) == ["B"]
    with pytest.raises(LookupError):
        store.read("ocr_results", version)


def test_two_writers_of_one_version(spark, store, monkeypatch):
    """The second fails and leaves nothing; it may try again."""
    other = Store(spark, store.folder)
    last = other._last()
    store.append("ocr_results", ocr(spark, (1, "A")))
    with monkeypatch.context() as m:
        m.setattr(other, "_last", lambda: last)
        with pytest.raises(Exception, match="exist"):
            other.append("ocr_results", ocr(spark, (2, "B")))
    assert schools(store) == ["A"]
    other.append("ocr_results", ocr(spark, (2, "B")))
    assert schools(store) == ["A", "B"]


def test_many_appends_are_written_as_one(spark, store, monkeypatch):
    monkeypatch.setattr(stored, "FOLDERS", 3)
    for i in range(5):
        store.append("ocr_results", ocr(spark, (i, str(i))))
    assert schools(store) == list("01234") and len(store._last()[1]["tables"]["ocr_results"]) < 4


def test_runs_and_single_issues(spark, store):
    header = spark.createDataFrame([(5, 4, 1, 1, "m")], "total_certs long, ocr_success long, issue_count long, high_severity_count long, message string")
    issues = spark.createDataFrame([("r", "d", "高", [1, 2])], "rule_name string, detail string, severity string, related_ids array<long>")
    assert [store.append_run(header, issues) for _ in range(2)] == [1, 2]
    assert sorted((r["run_id"], r["issue_type"]) for r in store.read("fraud_issues").collect()) == [(1, "cross"), (2, "cross")]
    single = spark.createDataFrame([(7, "a", "d", "中"), (8, "b", "d", "高")], "entity_id long, rule string, detail string, severity string")
    store.replace_single_issues(single, single.select("entity_id"))
    store.replace_single_issues(single.where("entity_id = 7").withColumn("rule", F.lit("c")), spark.createDataFrame([(7,)], "entity_id long"))
    got = store.read("fraud_issues").where("issue_type = 'single'")
    assert sorted((r["entity_id"], r["rule_name"], r["related_ids"]) for r in got.collect()) == [(7, "c", [7]), (8, "b", [8])]
    assert store.read("fraud_issues").count() == 4
    assert {r["table"]: r["n"] for r in store.counts().collect()}["cross_validate_runs"] == 2


def test_ingest_and_orphans(spark, store):
    files = spark.createDataFrame([("/in/b.PNG", 10, [1.0] * 512, [2.0] * 512, None), ("/in/a.jpg", 10, None, None, None), ("/in/c.gif", 10, None, None, None), ("/in/d.jpg", 99_999_999, None, None, None)],
                                  "path string, length long, image_vector array<double>, face_vector array<double>, template_vector array<double>")
    got = {r["path"]: (r["entity_id"], r["filename"]) for r in ingest.ingest(store, files).collect()}
    assert got == {"/in/a.jpg": (1, "1.jpg"), "/in/b.PNG": (2, "2.png")}
    vectors = {(r["entity_id"], r["vector_field"]): r["vector"] for r in store.read("vectors").collect()}
    assert len(vectors) == 6 and vectors[2, "face"][0] == 2 and vectors[1, "template"] == [0.0] * 1088
    assert {r["id"]: r["has_face"] for r in store.read("certificates").collect()} == {1: False, 2: True}
    assert {r["entity_id"] for r in ingest.ingest(store, files.where("path like '%b.PNG'")).collect()} == {3}, "ids go on after the largest"
    images = spark.createDataFrame([(2,), (3,)], "entity_id long")
    assert store.purge_orphans(images) == {"deleted": 1, "remaining": 2} and store.purge_orphans(images) == {"deleted": 0, "remaining": 2}


def test_a_failed_ingest_stores_nothing(spark, store):
    files = spark.createDataFrame([("/in/a.jpg", 10, None)], "path string, length long, image_vector array<double>")
    broken = files.withColumns({"face_vector": F.raise_error(F.lit("no face model")).cast("array<double>"), "template_vector": F.col("image_vector")})
    with pytest.raises(Exception, match="no face model"):
        ingest.ingest(store, broken)
    assert store.read("vectors").count() == store.read("certificates").count() == 0


def test_models_as_hooks_and_reruns(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "entity_id long, image string")
    done = spark.createDataFrame([(2, "old")], "entity_id long, text string")

    def make():
        return lambda frame: pd.DataFrame({"entity_id": frame["entity_id"], "text": frame["image"].str.upper()})

    answer = lambda df: ingest.extract(df, make, "entity_id long, text string")
    assert {tuple(r) for r in ingest.recognised(rows, done, answer).collect()} == {(1, "X"), (2, "old"), (3, "Z")}
    assert {tuple(r) for r in ingest.recognised(rows.where("entity_id = 2"), done, answer, again=True).collect()} == {(2, "Y")}
    assert ingest.recognised(rows.where("false"), done, answer).count() == 0
    assert stored.public_columns(done.withColumn("_raw", F.lit(1))).columns == ["entity_id", "text"]


RECORDS = "entity_id long, filename string, has_image boolean, image_error string, ocr_error boolean, enrollment_year string, grad_year string, issue_year string, birth_year string, gender string, face_age double, face_gender string, risk_flags array<string>"


def records(spark):
    return spark.createDataFrame([
        (1, "1.png", True, None, False, "2000", "2009", "2008", "1960", "男", 50.0, "F", ["f", "g"]),  # all five rules
        (2, "2.png", False, None, False, "2000", "2009", None, None, "男", None, None, None),  # no image
        (3, "3.png", True, "broken", False, "2000", "2009", None, None, "男", None, None, ["f"]),  # doesn't decode
        (4, "4.png", True, None, True, "2000", "2009", None, None, "男", 50.0, "F", None),  # not recognised: the face is left
        (5, None, True, None, None, "2000", "2004", "2004", "1982", "女", 20.0, "0.1", []),
        (6, "6.png", None, None, False, None, None, None, None, None, None, None, None),
    ], RECORDS)


WANT = {1: ("ok", 5, "高", 2), 2: ("skip", 0, None, 0), 3: ("error", 0, None, 0), 4: ("ok", 1, "中", 0), 5: ("ok", 0, "低", 0), 6: ("skip", 0, None, 0)}


def outcome(df):
    return {r["entity_id"]: (r["status"], len(r["issues"]), r["risk_level"], len(r["risk_flags"])) for r in df.collect()}


def test_batch_audit_with_faces_flags_and_events(spark, store):
    rows = records(spark)
    outcomes, events = batch_analyze(rows.unionByName(rows), store)
    assert outcome(outcomes) == WANT
    assert sorted(tuple(r) for r in events.collect())[2] == (3, 6, 3, "3.png", "error", None, "broken")
    assert sorted(r["entity_id"] for r in store.read("ocr_results").collect()) == [1, 4, 5]
    assert {r["entity_id"]: r["risk_level"] for r in store.read("forensic_results").collect()} == {1: "高", 4: "低", 5: "低"}
    batch_analyze(rows, store)
    assert store.read("fraud_issues").count() == 6, "single issues are replaced"
    assert store.latest("ocr_results").count() == 3
    fewer = audited(rows.select("entity_id", "enrollment_year", "grad_year", "issue_year", "birth_year", "gender"))
    assert fewer.where("status = 'ok'").count() == 6, "columns that are absent"
    assert batch_analyze(rows.where("false"))[1].count() == 0


def test_stream_events_and_store(spark, store, tmp_path):
    source, results, progress, checkpoint = (str(tmp_path / x) for x in ("in", "results", "progress", "checkpoint"))
    rows = records(spark)
    run = lambda: batch_analyze_stream(spark, source, rows.schema, results, progress, checkpoint, store).awaitTermination()
    rows.where("entity_id <= 3").write.parquet(source)
    run()
    rows.where("entity_id >= 2").write.mode("append").parquet(source)
    run()
    assert outcome(spark.read.parquet(results)) == WANT
    events = sorted((r["done"], r["total"], r["id"], r["status"]) for r in spark.read.parquet(f"{results}_events").collect())
    assert events == [(1, 3, 1, "ok"), (2, 3, 2, "skip"), (3, 3, 3, "error"), (4, 6, 4, "ok"), (5, 6, 5, "ok"), (6, 6, 6, "skip")]
    told = spark.read.parquet(progress).orderBy("done").collect()
    assert [(r["total"], r["ok"], r["skip"], r["error"], r["done"]) for r in told] == [(3, 1, 1, 1, 3), (3, 2, 1, 0, 6)]
    assert sorted(r["entity_id"] for r in store.read("ocr_results").collect()) == [1, 4, 5] and store.read("fraud_issues").count() == 6


def test_a_repeated_batch_replaces_what_it_wrote(spark, store, tmp_path, monkeypatch):
    """It fails after its commit, before its progress: nothing is there twice."""
    source, results, progress, checkpoint = (str(tmp_path / x) for x in ("in", "results", "progress", "checkpoint"))
    rows = records(spark)
    rows.write.parquet(source)
    plain = Store.commit

    def failing(self, *args, **kwargs):
        plain(self, *args, **kwargs)
        raise OSError("lost")

    run = lambda: batch_analyze_stream(spark, source, rows.schema, results, progress, checkpoint, store).awaitTermination()
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", failing)
        with pytest.raises(Exception, match="lost"):
            run()
    assert store.read("ocr_results").count() == 3
    run()
    assert outcome(spark.read.parquet(results)) == WANT and store.read("ocr_results").count() == 3
    assert spark.read.parquet(progress).count() == 1 and store.read("fraud_issues").count() == 6


def test_whole_tables_by_batch(spark):
    assert {r["status"] for r in audited(batch_records(spark, SF)).select("status").distinct().collect()} == {"ok", "skip", "error"}
