import numpy as np
import pytest

from pyspark.sql import functions as F

from certloom.operators import clustering, hierarchy, pairs, search, stages, variants
from certloom.operators.graph import components, in_tiles
from certloom.operators.order import numbered

GROUPS = {"A": (1, 2, 3), "B": (5, 6, 7), "C": (8, 9), "D": (10, 11), "E": (12, 13)}


@pytest.fixture(scope="module")
def golden(spark):
    """Fourteen vectors in five groups, two alone."""
    rows = []
    for i in range(1, 15):
        v = np.zeros(40)
        g = next((k for k, members in enumerate(GROUPS.values()) if i in members), None)
        v[g if g is not None else 5 + i % 3] = 1.0
        if g is not None:
            v[20 + i] = 0.02
        rows.append((i, (v / np.linalg.norm(v)).tolist()))
    return spark.createDataFrame(rows, "entity_id long, vector array<double>")


def partition(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["label"], set()).add(r["entity_id"])
    noise = out.pop(-1, set())
    return sorted(map(sorted, out.values())), noise


def test_golden_groups(golden):
    want = (sorted(map(list, GROUPS.values())), {4, 14})
    assert partition(clustering.dbscan(golden, 0.085)) == want
    assert partition(hierarchy.hdbscan(golden, 0.2)) == want


@pytest.mark.parametrize("block", [7, 1024])
def test_spanning_tree_is_one_edge_a_vector(spark, block, monkeypatch):
    """Merged trees have the lengths of the tree over all pairs, ties and copies too."""
    monkeypatch.setattr(pairs.block_pairs, "__defaults__", (block,))
    x = np.random.default_rng(3).integers(0, 4, size=(60, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>")
    tree = hierarchy.spanning_tree(df, "euclidean").collect()
    i, j = np.triu_indices(60, 1)
    want = hierarchy.tree_edges(np.arange(60), i, j, pairs.METRICS["euclidean"](x, x)[i, j])
    assert len(tree) == 59
    assert np.allclose(sorted(r["distance"] for r in tree), [d for _, _, d in want])
    labels = {r["entity_id"]: r["label"] for r in hierarchy.hdbscan(df, 0.5, metric="euclidean").collect()}
    monkeypatch.setattr(pairs.block_pairs, "__defaults__", (60,))
    assert labels == {r["entity_id"]: r["label"] for r in hierarchy.hdbscan(df, 0.5, metric="euclidean").collect()}


def test_sweep_scores_groups(spark, golden):
    """One tree for all settings gives what each setting gives alone; all seven groups are found."""
    expected = spark.createDataFrame([(i, g) for g, ids in GROUPS.items() for i in ids] + [(4, "4"), (14, "14")], "entity_id long, group string")
    radii = [0.01, 0.03, 0.5, 1.6]
    got = {(r["method"], r["epsilon"]): r for r in variants.sweep(golden, radii, expected=expected).collect()}
    assert len(got) == 8 and got["leaf", 0.03]["score"] == 7
    for method, epsilon in got:
        groups, noise = partition(hierarchy.hdbscan(golden, epsilon, metric="euclidean", method=method))
        score = sum(sorted(ids) in groups for ids in GROUPS.values()) + sum(i in noise for i in (4, 14))
        assert tuple(got[method, epsilon])[3:] == (len(groups), len(noise), score), (method, epsilon)


def test_leaves_and_greatest_mass(spark):
    """Two close pairs of pairs: leaves are four clusters, the greatest mass may be two."""
    places = [0.0, 0.1, 0.3, 0.4, 9.0, 9.1, 9.3, 9.4]
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate(places)], "entity_id long, vector array<double>")
    assert partition(hierarchy.hdbscan(df, 0.0, metric="euclidean", method="leaf"))[0] == [[0, 1], [2, 3], [4, 5], [6, 7]]
    assert partition(hierarchy.hdbscan(df, 1.0, metric="euclidean", method="leaf"))[0] == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_fused_and_grouped_pipelines(spark, golden):
    """Items of one colour keep their groups; noise left over is one label each; key clusters aren't merged."""
    plain = golden.selectExpr("entity_id", "vector", "array(0.5D, 1D) as color", "0D as asymmetry", "entity_id = 1 as is_key")
    groups, noise = partition(variants.fused_pipeline(plain))
    assert (groups, noise) == (sorted([*map(list, GROUPS.values()), [4], [14]]), set())
    groups, noise = partition(variants.fused_pipeline(plain, near=1.5))
    assert groups == [[1, 2, 3], [4, 14], [5, 6, 7, 8, 9, 10, 11, 12, 13]]
    assert partition(variants.fused_pipeline(plain.where("entity_id <= 7"), near=0.01)) == ([[1, 2, 3], [5, 6, 7]], {4})
    folded = plain.selectExpr("entity_id", "vector", "color", "is_key", "if(entity_id in (8, 9), 1D, 0D) as asymmetry")
    assert partition(variants.grouped_pipeline(folded, k=1)) == (sorted(map(list, GROUPS.values())), {4, 14})
    assert partition(variants.grouped_pipeline(folded, k=1, near=1.5))[0] == [[1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 13, 14], [8, 9]]
    two = plain.selectExpr("entity_id", "vector", "array(if(entity_id < 8, 0D, 9D), 0D) as color", "asymmetry", "is_key")
    assert partition(variants.grouped_pipeline(two, k=2)) == (sorted(map(list, GROUPS.values())), {4, 14})
    empty = plain.where("false")
    assert variants.fused_pipeline(empty).count() == variants.grouped_pipeline(empty).count() == variants.sweep(empty, [0.1]).count() == 0


def test_group_folders(spark, golden, tmp_path):
    labels = clustering.dbscan(golden, 0.085)
    names = golden.selectExpr("entity_id", "concat(entity_id, '.png') as filename")
    assert [tuple(r) for r in variants.group_folders(labels).orderBy("position").select("folder", "count").collect()][:3] == [("template_00", 3), ("template_01", 3), ("unique_or_noise", 2)]
    variants.write_groups(labels, names, str(tmp_path / "groups"))
    got = spark.read.parquet(str(tmp_path / "groups")).where("folder = 'unique_or_noise'").collect()
    assert {r["filename"] for r in got} == {"4.png", "14.png"}


def test_hierarchy_of_none_and_one(spark):
    one = spark.createDataFrame([(5, [1.0, 0.0])], "entity_id long, vector array<double>")
    assert [tuple(r) for r in hierarchy.hdbscan(one, 0.2).collect()] == [(5, -1)]
    assert hierarchy.hdbscan(one.limit(0), 0.2).count() == 0


def test_labels_follow_first_members(golden):
    labels = {r["entity_id"]: r["label"] for r in clustering.dbscan(golden, 0.085).collect()}
    assert [labels[m[0]] for m in GROUPS.values()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("block", [3, 1024])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_give_all_pairs(spark, metric, block, monkeypatch):
    monkeypatch.setattr(pairs.block_pairs, "__defaults__", (block,))
    x = np.random.default_rng(1).standard_normal((17, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>")
    got = {(r["a"], r["b"]): r["distance"] for r in pairs.distances(df, metric).collect()}
    d = pairs.METRICS[metric](x, x)
    assert len(got) == 17 * 16 // 2
    assert all(abs(got[i, j] - d[i, j]) < 1e-9 for i in range(17) for j in range(i + 1, 17))
    near = {(r["entity_id"], r["rank"]): r["neighbour"] for r in pairs.nearest(df, 3, metric).collect()}
    for i in range(17):
        order = [j for j in np.lexsort((np.arange(17), d[i])) if j != i][:3]
        assert [near[i, k] for k in (1, 2, 3)] == order


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 130)] + [(200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {x: 100 for x in range(100, 130)}


def test_positions(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 7, 3)], "x long")
    assert sorted((r["position"], r["x"]) for r in numbered(df, "x").collect()) == [(0, 1), (1, 3), (2, 3), (3, 5), (4, 7), (5, 9)]
    assert numbered(df.where("x > 100"), "x").collect() == []


def test_search(golden):
    got = search.search_by_id(golden, 1, 3)
    rows = got.collect()
    assert [r["entity_id"] for r in rows] == [1, 2, 3] and rows[0]["is_abnormal"]
    assert [r["entity_id"] for r in search.search_by_id(golden, 1, 1, exclude_self=True).collect()] == [4]
    with pytest.raises(ValueError):
        search.check_request([1.0], None, 2, 5)
    with pytest.raises(ValueError):
        search.check_request(None, 1, 2, 101)
    with pytest.raises(LookupError):
        search.search_by_id(golden, 99)


def test_few_vectors_get_the_default_radius(golden):
    few = golden.where("entity_id <= 2")
    assert clustering.estimate_eps(few) == 0.085
    _, used = clustering.cluster(few)
    assert used["eps_used"] == 0.085


def test_stages(spark):
    rows = [(i, [1.0, 0.1 * (i % 2)], 0.01 if i < 2 else 0.2, 0) for i in range(4)]
    rows += [(i, [0.0, 1.0], 0.01, 1) for i in (4, 5)] + [(6, [0.0, 0.9], 0.01, -1), (7, [-1.0, 0.0], 0.0, -1), (8, [-1.0, 0.1], 0.0, -1), (9, [0.0, -1.0], 0.0, -1)]
    items = spark.createDataFrame(rows, "entity_id long, vector array<double>, asymmetry double, label long")
    split = stages.layout_split(items)
    assert {r["entity_id"]: r["label"] for r in split.collect() if r["entity_id"] < 4} == {0: 0, 1: 0, 2: 2, 3: 2}
    merged = {r["entity_id"]: r["label"] for r in stages.merge(split).collect()}
    assert merged[0] != merged[2], "layouts differ"
    done = {r["entity_id"]: r["label"] for r in stages.template_pipeline(items).collect()}
    assert done[6] == done[4] and done[7] == done[8] >= 0 and done[9] == -1
    facts = stages.noise_diagnostics(items).first()
    assert facts["count"] == 4 and facts["min_dist"] == 0.1


def test_histogram_ends(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "distance double")
    got = [r["count"] for r in clustering.histogram(df, 4).orderBy("bin").collect()]
    assert got == [1, 0, 1, 1]


def test_components_in_one_tile_and_in_many(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(a) + 1) for a in range(0, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (250, 2))] + [(None, 5), (7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in up}
    df = spark.createDataFrame(edges, "a long, b long")
    for tile in (200_000, 40):
        assert {tuple(r) for r in components(df, tile).collect()} == want
    assert components(df.where("false")).count() == 0


def test_tiles_are_bounded(spark):
    """Also if all edges are in one partition, which joining partitions can't split."""
    edges = spark.range(10_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).coalesce(1)
    sizes = [r["n"] for r in in_tiles(edges, 25).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 25 and max(sizes) <= 2 * 10_000 // 25


@pytest.mark.parametrize(("metric", "most"), [("cosine", 0.02), ("euclidean", 0.7)])
def test_cells_find_all_pairs_within_a_radius(spark, metric, most, monkeypatch):
    """The same pairs as without cells, most of them never looked at where vectors lie in
    clumps; copies and zero vectors too."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(rng.normal(size=12) * 3, 0.15, size=(40, 12)) for _ in range(12)])
    x[5:9], x[17], x[333] = x[4], 0, 0
    df = spark.createDataFrame([(i + 2**60, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>")
    pairs_of = lambda rows: {(r["a"], r["b"]): r["distance"] for r in rows.collect()}
    for below in (False, True):
        monkeypatch.setattr(pairs, "CELLS_FROM", 10_000)
        want = pairs_of(pairs.distances(df, metric, most, below))
        monkeypatch.setattr(pairs, "CELLS_FROM", 10)
        monkeypatch.setattr(pairs, "BLOCK", 60)
        got = pairs_of(pairs.distances(df, metric, most, below))
        assert len(want) > 100 and set(got) == set(want) and all(abs(got[k] - d) < 1e-6 for k, d in want.items())
    assert pairs.Cells.of(df, most, metric).skipped > 0.6
    assert pairs.Cells.of(df.where("false"), most, metric).near().count() == 0


def test_blocks_meet_in_few_groups(spark):
    """A block is sent once for each of a bounded number of groups, not for every other block;
    neighbours among copies go by id."""
    x = np.random.default_rng(3).integers(0, 3, (200, 3)).astype(float) + 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>")
    met = pairs.block_pairs(df, 1)
    assert met.count() <= (pairs.GROUPS + 1) * (pairs.GROUPS + 2) // 2
    held = np.full((200, 5), np.inf), np.full((200, 5), 10**9)
    d = pairs.euclidean_distances(x, x)
    np.fill_diagonal(d, np.inf)
    for at in range(0, 200, 7):
        held = pairs.nearer(held, d[:, at : at + 7], np.arange(at, min(200, at + 7)))
    assert (held[1] == np.array([np.lexsort((np.arange(200), row))[:5] for row in d])).all()


@pytest.mark.parametrize("cells", [10, 10_000])
def test_pairs_that_join_are_fewer_than_vectors(spark, cells, monkeypatch):
    """A clump of copies makes a forest in each pair of groups, with the components of all its pairs."""
    monkeypatch.setattr(pairs, "CELLS_FROM", cells)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(5, 0.01, (150, 3)), rng.normal(0, 1, (60, 3)), rng.normal(-9, 0.01, (40, 3))])
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>")
    links = [(r["a"], r["b"]) for r in pairs.distances(df, "euclidean", 0.4, joining=True).collect()]
    every = {(r["a"], r["b"]): r["distance"] for r in pairs.distances(df, "euclidean", 0.4).collect()}
    assert len(links) < len(x) < len(every) and set(links) <= set(every)

    def parts(edges):
        up = {i * 3: i * 3 for i in range(len(x))}
        for a, b in edges:
            low, high = sorted((up[a], up[b]))
            up = {k: low if v == high else v for k, v in up.items()}
        return up

    assert parts(links) == parts(every)


def test_nearest_of_meets_in_groups(spark, monkeypatch):
    """Ties go to the smaller target in whatever block it is, and rows that meet are groups, not blocks."""
    blocks_of, groups_met, met = pairs.blocks_of, pairs.groups_met, []
    monkeypatch.setattr(pairs, "blocks_of", lambda vectors: blocks_of(vectors, 8))

    def counted(grouped, pairs_of_groups, n):
        met.append((pairs_of_groups.count(), n))
        return groups_met(grouped, pairs_of_groups, n)

    monkeypatch.setattr(pairs, "groups_met", counted)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3, (300, 3)).astype(float), rng.integers(0, 3, (400, 3)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>")
    targets = spark.createDataFrame([(1000 - i, v.tolist()) for i, v in enumerate(y)], "target long, vector array<double>")
    d = pairs.euclidean_distances(x, y[::-1])
    got = {r["entity_id"]: (r["target"], r["distance"]) for r in pairs.nearest_of(rows, targets).collect()}
    assert got == {i: (601 + int(d[i].argmin()), float(d[i].min())) for i in range(300)}
    assert len(met) == 1 and met[0][0] == met[0][1] < 38 * 50
