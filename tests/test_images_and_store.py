import numpy as np

from certloom.operators import forensics
from certloom.plans import rule_queries
from certloom.sources import images
from certloom.sources.records import credentials
from certloom.sources.store import Store, latest, with_dimension
from certloom.streaming.audit_stream import batch_analyze_stream


def test_flat_image_has_no_error_and_no_edges():
    flat = np.full((40, 40, 3), 128, dtype=np.uint8)
    assert forensics.error_level(flat)["ela_std"] == 0
    assert forensics.photo_edge(flat)["max_gradient"] == 0
    assert forensics.seal(flat)["red_count"] == 0
    assert forensics.asymmetry(flat) == 0


def test_pasted_square_is_sharp():
    x = np.tile(np.linspace(100, 120, 100).astype(np.uint8)[None, :, None], (100, 1, 3))
    x[10:30, 70:90] = 255
    edge = forensics.photo_edge(x)
    assert edge["max_gradient"] > 200 and edge["noise_ratio"] > 1.5


def test_printed_and_inked_seals():
    page = np.full((100, 100, 3), 255, dtype=np.uint8)
    yy, xx = np.mgrid[:100, :100]
    disc = (yy - 50) ** 2 + (xx - 50) ** 2 < 400
    page[disc] = (200, 180, 180)
    page[disc] = (200, 150, 150)
    assert forensics.seal(page)["color_variance"] < 600
    rng = np.random.default_rng(1)
    noisy = page.copy()
    noisy[disc] = np.column_stack([rng.integers(150, 255, disc.sum()), rng.integers(0, 60, disc.sum()), rng.integers(0, 60, disc.sum())])
    assert forensics.seal(noisy)["color_variance"] > 600


def test_hashes_and_layout():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 255, (64, 64, 3)).astype(np.uint8)
    h = forensics.mean_hash(x)
    assert len(h) == 64 and forensics.mean_hash(x) == h
    near = bin(int(h, 16) ^ int(forensics.mean_hash(np.clip(x.astype(int) + 1, 0, 255).astype(np.uint8)), 16)).count("1")
    assert near < 10
    half = np.full((64, 64, 3), 255, dtype=np.uint8)
    half[::8, :32] = 0
    assert forensics.asymmetry(half) > 0.5 > forensics.asymmetry(np.concatenate([half[:, :32], half[:, 31::-1]], axis=1)) + 0.4


def bitmap(pixels: np.ndarray) -> bytes:
    """A 24-bit BMP of RGB pixels."""
    h, w, _ = pixels.shape
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * (-3 * w % 4) for r in pixels[::-1])
    head = b"BM" + (54 + len(rows)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little")
    return head + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + b"\x01\0\x18\0" + b"\0" * 4 + len(rows).to_bytes(4, "little") + b"\0" * 16 + rows


def test_image_folder(spark, tmp_path):
    x = np.zeros((32, 32, 3), dtype=np.uint8)
    x[:, :, 0] = 200
    (tmp_path / "12.bmp").write_bytes(bitmap(x))
    (tmp_path / "13.BMP").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    found = {r["path"].rsplit("/", 1)[1]: (r["entity_id"], r["is_valid"]) for r in images.files(spark, str(tmp_path)).collect()}
    assert found == {"12.bmp": (12, True), "13.BMP": (13, True), "notes.txt": (None, False)}
    assert sorted(r["entity_id"] for r in images.stored_ids(spark, str(tmp_path)).collect()) == [12, 13]
    measured = {r["entity_id"]: r for r in forensics.measure(images.pixels(spark, str(tmp_path))).collect()}
    assert {k: (r["red_count"], r["error"]) for k, r in measured.items()} == {12: (1024, None), 13: (None, images.UNREADABLE)}
    good = measured[12]
    assert good["aspect_ratio"] == 1 and not good["is_fold"] and good["hist_chi2"] == 0 == good["brightness_diff"]
    assert len(good["border"]) == 64 and good["mean_color"][0] == 0 and good["mean_color"][3] == 10
    assert measured[13]["border"] is None and measured[13]["is_fold"] is None


def test_images_as_a_stream(spark, tmp_path):
    folder, out, checkpoint = (tmp_path / x for x in ("in", "out", "checkpoint"))
    folder.mkdir()
    flat = np.full((20, 30, 3), 90, dtype=np.uint8)

    def run():
        forensics.measured_stream(images.pixels(spark, str(folder), stream=True), str(out), str(checkpoint)).awaitTermination()
        return sorted((r["entity_id"], r["error"], r["aspect_ratio"]) for r in spark.read.parquet(str(out)).collect())

    (folder / "1.bmp").write_bytes(bitmap(flat))
    (folder / "notes.txt").write_text("x")
    assert run() == [(1, None, 1.5)]
    (folder / "2.png").write_bytes(b"no image")
    (folder / "4.png").write_bytes(b"")
    (folder / "3.BMP").write_bytes(bitmap(flat[:10]))
    assert run() == [(1, None, 1.5), (2, images.UNREADABLE, None), (3, None, 3.0)]
    assert len(run()) == 3, "nothing is measured twice"


def test_rows_that_cannot_be_measured(spark):
    rows = spark.createDataFrame([(1, 2, 2, 3, b"abc", None), (2, None, None, None, None, "gone"), (None, 1, 1, 1, b"x", None)], "entity_id long, height int, width int, channels int, data binary, error string")
    got = {r["entity_id"]: r for r in forensics.measure(rows.withColumn("path", rows.error).withColumn("border", rows.width)).collect()}
    assert got[1]["error"] and got[2]["error"] == "gone" and got[None]["error"] is None and got[None]["aspect_ratio"] == 1
    assert forensics.measure(rows.where("false")).count() == 0


def test_fold_and_halves():
    page = np.full((60, 100, 3), 200, dtype=np.uint8)
    page[:, 49:51] = 60
    assert forensics.fold(page)["is_fold"] and not forensics.fold(np.full((60, 100, 3), 200, dtype=np.uint8))["is_fold"]
    page[:, 50:] = 100
    unlike = forensics.layout_diagnostics(page)
    assert unlike["brightness_diff"] > 0.3 and unlike["hist_chi2"] > 0.9


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    row = spark.createDataFrame([(1, "A"), (2, "B")], "entity_id long, school string").selectExpr("*", "timestamp'2020-01-01' as created_at")
    store.append("ocr_results", row)
    store.append("ocr_results", row.where("entity_id = 1").selectExpr("entity_id", "'C' as school", "timestamp'2021-01-01' as created_at"))
    assert {(r["entity_id"], r["school"]) for r in store.latest("ocr_results").collect()} == {(1, "C"), (2, "B")}
    store.delete("ocr_results", spark.createDataFrame([(1,)], "entity_id long"))
    assert [r["entity_id"] for r in store.read("ocr_results").collect()] == [2]
    assert {r["table"]: r["n"] for r in store.counts().collect()}["ocr_results"] == 1


def test_latest_and_dimensions(spark):
    import pytest

    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k long, t long, v string")
    assert {r["v"] for r in latest(df, "k", "t").collect()} == {"b", "c"}
    v = spark.createDataFrame([(1, [1.0])], "entity_id long, vector array<float>")
    with pytest.raises(Exception, match="expected 2 components"):
        with_dimension(v, 2).collect()


def test_stream_is_idempotent(spark, tmp_path):
    records = credentials(spark, "/root/testdata/sf0.001")
    source, out = str(tmp_path / "in"), [str(tmp_path / x) for x in ("results", "progress", "checkpoint")]
    records.write.parquet(source)
    for _ in range(2):
        batch_analyze_stream(spark, source, records.schema, *out).awaitTermination()
        records.limit(10).write.mode("append").parquet(source)
    got = spark.read.parquet(out[0])
    assert got.count() == records.count() == got.select("entity_id").distinct().count()
    assert spark.read.parquet(out[1]).agg({"total": "sum"}).first()[0] == records.count()


def test_registered_queries_have_stable_columns(spark):
    for name in ("rule6_principal_conflict", "cross_validate_run"):
        assert rule_queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns
