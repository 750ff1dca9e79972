import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from certloom.operators import clustering, pair_stats, pairs, search, search_index, stages
from certloom.operators.search_index import Index


def frame(spark, x, labels=None):
    rows = [(i + 10, v.tolist(), None if labels is None or labels[i] is None else int(labels[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "entity_id long, vector array<double>, label long")


@pytest.fixture(scope="module")
def clumps():
    """Twelve clumps of a hundred vectors, with copies."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(rng.normal(size=16) * 3, 0.2, size=(100, 16)) for _ in range(12)])
    x[40:46] = x[40]
    return x


@pytest.fixture(scope="module")
def index(spark, clumps, tmp_path_factory):
    mp = pytest.MonkeyPatch()
    mp.setattr(search_index, "OF_PIVOT", 60)
    mp.setattr(search_index, "ROW_GROUP", 8 * 1024)
    folder = str(tmp_path_factory.mktemp("index") / "i")
    odd = spark.createDataFrame([(1, [0.0] * 16), (2, None), (3, [float("nan")] * 16), (4, [None] + [1.0] * 15)], "entity_id long, vector array<double>")
    both = frame(spark, clumps).select("entity_id", "vector").unionByName(odd)
    fields = both.withColumn("vector_field", F.lit("image")).unionByName(frame(spark, clumps[:50] * -1).select("entity_id", "vector").withColumn("vector_field", F.lit("face")))
    made = Index.build(fields, folder)
    mp.undo()
    return made


def rows_of(df):
    return [(r["entity_id"], round(r["score"], 9), round(r["distance"], 9), r["is_abnormal"]) for r in df.collect()]


@pytest.mark.parametrize("at", [45, 1199])
@pytest.mark.parametrize("exclude", [False, True])
def test_index_equals_a_scan(spark, clumps, index, at, exclude):
    store = frame(spark, clumps).select("entity_id", "vector")
    for k in (1, 30):
        assert rows_of(index.search("image", clumps[at], k, exclude)) == rows_of(search.search(store, clumps[at], k, exclude))
        assert index.share < 0.5, "most cells are never read"
    far = -clumps[at]
    assert rows_of(index.search("image", far, 7)) == rows_of(search.search(store, far, 7))


def test_index_asks_for_more_than_there_is(spark, clumps, index):
    assert index.search("image", clumps[0], 100_000).count() == len(clumps) and index.share == 1
    assert index.search("image", [0.0] * 16, 5).count() == index.search("none", clumps[0], 5).count() == 0
    face = index.search("face", clumps[0], 50)
    assert {r["entity_id"] for r in face.collect()} == set(range(10, 60)), "a field holds its own vectors"


def test_radius_by_index(spark, clumps, index):
    score = clumps @ clumps[3] / np.linalg.norm(clumps, axis=1) / np.linalg.norm(clumps[3])
    want = {i + 10 for i in np.flatnonzero(1 - score <= 0.05)}
    assert len(want) > 50 and {r["entity_id"] for r in index.within("image", clumps[3], 0.05).collect()} == want
    assert index.within("image", [0.0] * 16, 0.5).count() == 0


def test_index_skips_row_groups(index, clumps):
    """The statistics in the files rule most row groups out for a near search."""
    index.search("image", clumps[3], 5)
    cells = index._cells("image", clumps[3])
    bound = float(np.sqrt(2 * 0.02))
    rings = [(c["cell"], c["apart"] - bound, c["apart"] + bound) for c in cells if c["nearest"] <= bound]
    kept = total = 0
    for path in glob.glob(f"{index.folder}/vectors/vector_field=image/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            cell, far = (meta.row_group(g).column(names.index(c)).statistics for c in ("cell", "far"))
            total += 1
            kept += any(cell.min <= c <= cell.max and far.min <= high and far.max >= low for c, low, high in rings)
    assert total >= 8 and kept <= total / 2
    plan = index.vectors("image").where(index.ring(cells[:2], bound))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(" in plan and "PartitionFilters: [isnotnull(vector_field" in plan


def test_vectors_added_later_are_found(spark, clumps, tmp_path):
    store = frame(spark, clumps[:300]).select("entity_id", "vector").withColumn("vector_field", F.lit("image"))
    made = Index.build(store, str(tmp_path / "i"))
    more = frame(spark, np.concatenate([np.zeros((300, 16)), clumps[300:600]])).where("entity_id >= 310").withColumn("vector_field", F.lit("image"))
    made.add(more)
    again = Index(spark, made.folder)
    whole = store.select("entity_id", "vector").unionByName(more.select("entity_id", "vector"))
    for at in (5, 450):
        assert rows_of(again.search("image", clumps[at], 20)) == rows_of(search.search(whole, clumps[at], 20))
    with pytest.raises(Exception, match="no field"):
        made.add(more.withColumn("vector_field", F.lit("other")))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block", [7, 1024])
def test_statistics_of_pairs(spark, metric, block, monkeypatch):
    """Equal to what a table of all pairs gives, copies and ties included."""
    monkeypatch.setattr(pair_stats, "SORTED", 20)
    x = np.random.default_rng(2).integers(-2, 3, size=(45, 3)).astype(float)
    x[7] = x[8] = x[9]
    x[3] = 0
    labels = [None if i == 44 else (9 if i == 43 else i % 3) for i in range(45)]
    df = frame(spark, x, labels)
    i, j = np.triu_indices(45, 1)
    d = pairs.METRICS[metric](x, x)[i, j]
    stats = pair_stats.Distances(df, metric, block)
    n, low, high, total = stats.extent()
    assert n == len(d) and np.allclose([low, high, total], [d.min(), d.max(), d.sum()])
    places = [0, 1, len(d) // 4, len(d) // 2, len(d) - 1]
    got = stats.at([*places, len(d)])
    assert set(got) == set(places) and np.allclose([got[p] for p in places], np.sort(d)[places], atol=1e-7)
    assert sum(r["count"] for r in stats.histogram(20).collect()) == len(d)
    if metric == "euclidean":
        key = sorted((round(v, 9), a + 10, b + 10) for v, a, b in zip(d, i, j))
        assert [(r["a"], r["b"]) for r in stats.least(12).collect()] == [(a, b) for _, a, b in key[:12]]
        key = sorted((-round(v, 9), a + 10, b + 10) for v, a, b in zip(d, i, j))
        assert [(r["a"], r["b"]) for r in stats.least(5, greatest=True).collect()] == [(a, b) for _, a, b in key[:5]]
    groups, items = {}, {}
    for v, a, b in zip(d, i, j):
        if labels[a] is not None and labels[b] is not None:
            groups.setdefault(tuple(sorted((labels[a], labels[b]))), []).append(v)
            if labels[a] == labels[b]:
                items.setdefault(a + 10, []).append(v)
                items.setdefault(b + 10, []).append(v)
    for found, want, key in ((pair_stats.between_groups(df, metric, block), groups, lambda r: (r["label1"], r["label2"])), (pair_stats.within_groups(df, metric, block), items, lambda r: r["entity_id"])):
        rows = found.collect()
        assert {key(r) for r in rows} == set(want) and len(rows) == len(want)
        for r in rows:
            v = want[key(r)]
            assert np.allclose([r["least"], r["greatest"], r["mean"]], [min(v), max(v), np.mean(v)], atol=1e-7)
            assert "pairs" not in r or r["pairs"] == len(v)


def test_statistics_of_few(spark):
    one = frame(spark, np.ones((1, 2)), [0])
    for df in (one, one.where("false")):
        stats = pair_stats.Distances(df)
        assert stats.extent()[0] == 0 and stats.at([0]) == {} and stats.histogram().count() == stats.least(3).count() == 0
        assert pair_stats.between_groups(df).count() == pair_stats.within_groups(df).count() == 0
    facts = stages.noise_diagnostics(one.withColumn("label", F.lit(-1)))
    assert tuple(facts.first()) == (1, None, None, None, [])
    with pytest.raises(ValueError, match="too few"):
        clustering.cluster_debug(one)


def test_debug_of_templates(spark):
    """By euclidean distance; radii that join something."""
    x = np.repeat(np.eye(4), 3, axis=0) + np.tile([[0.0], [0.04], [0.12]], (4, 1)) * np.eye(4)[np.repeat(range(4), 3)]
    found = clustering.cluster_debug(frame(spark, x), "euclidean")
    sweep = {round(r["eps"], 2): (r["n_clusters"], r["n_noise"]) for r in found["eps_candidates"].collect()}
    assert (sweep[0.03], sweep[0.05], sweep[0.1]) == ((0, 12), (4, 4), (4, 0)) and found["sample_count"] == 12
    assert sum(r["count"] for r in found["distance_histogram"].collect()) == 66


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_radii_of_one_forest(spark, monkeypatch, metric, few):
    """Clusters and noise of every radius equal those of the whole graph, by blocks and by cells, by one
    task and in rounds; no neighbours and no histogram are sought for them."""
    monkeypatch.setattr(pairs, "BLOCK", 16)
    monkeypatch.setattr(pairs, "HANDED", 20)
    monkeypatch.setattr(pairs, "CELLS_FROM", 1000 if few else 10)
    monkeypatch.setattr(clustering, "TASK", 1000 if few else 10)
    monkeypatch.setattr(clustering, "k_distances", None)
    rng = np.random.default_rng(3)
    x = np.eye(6)[rng.integers(0, 6, 90)] + rng.standard_normal((90, 6)) * rng.choice([0.02, 0.1, 0.3], (90, 1))
    x[40:43] = x[4]
    d = pairs.METRICS[metric](x, x)
    got = {r["eps"]: (r["n_clusters"], r["n_noise"]) for r in clustering.eps_candidates(frame(spark, x), metric).collect()}
    assert len(got) == 13 and len(set(got.values())) > 4
    for eps, facts in got.items():
        up = list(range(90))
        for _ in range(90):
            up = [min(up[j] for j in np.flatnonzero((d[i] <= eps) | (np.arange(90) == i))) for i in range(90)]
        sizes = np.unique(up, return_counts=True)[1]
        assert facts == ((sizes > 1).sum(), (sizes == 1).sum())
    with pytest.raises(ValueError, match="too few"):
        clustering.eps_candidates(frame(spark, x[:2]), metric)
