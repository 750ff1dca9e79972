"""The hierarchy by subtrees against a sequential one over the whole tree."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from certloom.operators import hierarchy, pairs
from certloom.operators.hierarchy import Sets


# a sequential hierarchy over one sorted tree, from the top


def condensed(n: int, edges: list[tuple[int, int, float]], least: int) -> tuple[list[tuple[int, int, float, int]], int]:
    """(parent, child, lambda, size) of the condensed tree; points below n, root n."""
    sets, node, size = Sets(2 * n), list(range(2 * n)), [1] * n + [0] * n
    left, right, height = [0] * (2 * n), [0] * (2 * n), [0.0] * (2 * n)
    top = n
    for a, b, d in edges:
        ra, rb = sets.find(a), sets.find(b)
        left[top], right[top], height[top], size[top] = node[ra], node[rb], d, size[node[ra]] + size[node[rb]]
        sets.up[ra] = rb
        node[rb] = top
        top += 1
    root, rows, fresh = top - 1, [], n + 1

    def points(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += [left[y], right[y]]
        return out

    todo = [(root, n)]
    while todo:
        x, label = todo.pop()
        if x < n:
            continue
        lam = 1 / height[x] if height[x] > 0 else np.inf
        kids, merged = [], [left[x], right[x]]
        while merged:
            k = merged.pop()
            if k >= n and height[k] == height[x]:  # merged at one distance: one split
                merged += [left[k], right[k]]
            else:
                kids.append(k)
        big = [k for k in kids if size[k] >= least]
        rows += [(label, p, lam, 1) for k in kids if size[k] < least for p in points(k)]
        if len(big) == 1:
            todo.append((big[0], label))
            continue
        for k in big:
            rows.append((label, fresh, lam, size[k]))
            todo.append((k, fresh))
            fresh += 1
    return rows, fresh


def select(n: int, rows: list[tuple[int, int, float, int]], fresh: int, epsilon: float, method: str = "eom") -> dict[int, int]:
    """The cluster of each point that has one, as a label of the condensed tree.

    ``method``: "eom", greatest excess of mass, or "leaf", clusters without clusters below.
    """
    birth, parent, kids, mass = {n: 0.0}, {}, {}, {}
    for p, c, lam, _ in rows:
        if c >= n:
            birth[c], parent[c] = lam, p
            kids.setdefault(p, []).append(c)
    for p, _, lam, size in rows:
        finite = min(lam, 1e12)
        mass[p] = mass.get(p, 0.0) + (finite - min(birth[p], 1e12)) * size
    chosen = {}
    for c in range(fresh - 1, n, -1):
        below = sum(mass.get(k, 0.0) for k in kids.get(c, []))
        chosen[c] = not kids.get(c) or method == "eom" and mass.get(c, 0.0) >= below
        if not chosen[c]:
            mass[c] = below
    clusters, todo = [], list(kids.get(n, []))
    while todo:
        c = todo.pop()
        if chosen[c]:
            clusters.append(c)
        else:
            todo += kids.get(c, [])
    final = set()
    for c in clusters:
        while birth[c] > 0 and 1 / birth[c] < epsilon and parent[c] != n:
            c = parent[c]
        final.add(c)
    final = {c for c in final if not any(a in final for a in ancestors(c, parent))}
    return {p: f for q, p, _, _ in rows if p < n for f in [q, *ancestors(q, parent)] if f in final}


def ancestors(c: int, parent: dict[int, int]) -> list[int]:
    out = []
    while c in parent:
        c = parent[c]
        out.append(c)
    return out


def labelled(frame: pd.DataFrame, epsilon: float, least: int, method: str) -> pd.DataFrame:
    """(entity_id, label) of the ids of a spanning tree."""
    frame = frame.sort_values(["distance", "a", "b"])
    ids = np.unique(np.concatenate([frame["a"], frame["b"]]))
    i, j = np.searchsorted(ids, frame["a"]), np.searchsorted(ids, frame["b"])
    rows, fresh = condensed(len(ids), list(zip(i.tolist(), j.tolist(), frame["distance"].tolist())), least)
    of = select(len(ids), rows, fresh, epsilon, method)
    number: dict[int, int] = {}
    return pd.DataFrame({"entity_id": ids, "label": [number.setdefault(of[p], len(number)) if p in of else -1 for p in range(len(ids))]})




def frame_of(spark, x):
    return spark.createDataFrame([(i * 7 + 2**60, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>")


CASES = {
    "spread": np.random.default_rng(1).standard_normal((60, 2)),
    "ties": np.random.default_rng(2).integers(0, 6, size=(60, 2)).astype(float),
    "chain": np.cumsum(1 + np.arange(40) / 50)[:, None].astype(float),
    "copies": np.repeat(np.array([[0.0, 0], [0, 0.1], [5, 5], [5, 5.2], [9, 0]]), 9, axis=0),
    "groups": np.concatenate([np.random.default_rng(3 + i).normal(c, s, size=(15, 2)) for i, (c, s) in enumerate([(0, 0.1), (1, 0.1), (8, 0.5), (9.5, 0.2)])]),
}


@pytest.mark.parametrize(("case", "least"), zip(CASES, (2, 2, 2, 5, 5)))
def test_subtrees_equal_the_whole_tree(spark, monkeypatch, case, least):
    """Also with tasks of 20 edges, so that most components go up as nodes or meet in groupings."""
    df = frame_of(spark, CASES[case])
    settings = [(m, e, least) for m in ("eom", "leaf") for e in (0.0, 0.3, 1.2)]
    tree = hierarchy.spanning_tree(df, "euclidean").toPandas()
    for task in (20, 200_000) if case in ("ties", "groups") else (200_000,):
        monkeypatch.setattr(hierarchy, "TASK", task)
        got = {}
        for r in hierarchy.hdbscan_sweep(df, settings, "euclidean").collect():
            got.setdefault((r["method"], r["epsilon"]), {})[r["entity_id"]] = r["label"]
        for method, epsilon, _ in settings:
            want = labelled(tree, epsilon, least, method)
            assert got[method, epsilon] == dict(zip(want["entity_id"], want["label"])), (task, method, epsilon)


def test_rounds_of_least_edges_make_the_tree(spark, monkeypatch):
    """Beyond the size that tasks merge, with ties and copies."""
    x = np.random.default_rng(5).integers(0, 5, size=(70, 2)).astype(float)
    df = frame_of(spark, x)
    monkeypatch.setattr(pairs.block_pairs, "__defaults__", (9,))
    want = sorted(r["distance"] for r in hierarchy.spanning_tree(df, "euclidean").collect())
    monkeypatch.setattr(hierarchy, "MERGED", 4)
    got = hierarchy.spanning_tree(df, "euclidean").collect()
    assert len(got) == 69 and np.allclose(sorted(r["distance"] for r in got), want)
    assert len({frozenset((r["a"], r["b"])) for r in got}) == 69


def test_large_sizes_in_one_split(spark, monkeypatch):
    """Copies that no task could hold meet by grouping, and leave no cluster below theirs."""
    monkeypatch.setattr(hierarchy, "TASK", 50)
    df = spark.range(400).select(F.col("id").alias("entity_id"), F.when(F.col("id") < 200, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"))
    got = {r["entity_id"]: r["label"] for r in hierarchy.hdbscan(df, 0.2).collect()}
    assert got == {i: int(i >= 200) for i in range(400)}


def test_a_way_up_is_gone_once():
    """A leaf at every step of a long chain, all of which give way to the top."""
    n, looked = 3_000, [0]

    class Counted(dict):
        def __getitem__(self, key):
            looked[0] += 1
            return super().__getitem__(key)

    parent = Counted({0: None} | {i: i - 1 for i in range(1, n)} | {n + i: i for i in range(n)})
    birth = {c: 1.0 if c == 0 else 0.5 for c in parent}
    assert hierarchy.risen(parent, birth, set(range(n, 2 * n)), 0.9) == {0}
    assert looked[0] <= 8 * n
    assert hierarchy.risen(parent, birth, {n, n + 5}, 0.5) == {n, n + 5}


def test_a_tree_sought_within_a_radius(spark, monkeypatch):
    """The same tree, from fewer edges, with copies, a clump and vectors far from all."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (500, 6)), rng.normal(8, 0.01, (60, 6)), np.repeat(rng.normal(4, 1, (5, 6)), 20, axis=0), rng.normal(40, 9, (12, 6))])
    df = frame_of(spark, x)
    monkeypatch.setattr(pairs.block_pairs, "__defaults__", (200,))
    monkeypatch.setattr(hierarchy, "SOUGHT_FROM", 100)
    radius = hierarchy.joining_radius(df, "euclidean")
    assert hierarchy.candidate_edges(df, "euclidean", radius).count() < hierarchy.candidate_edges(df, "euclidean").count()
    got = hierarchy.spanning_tree(df, "euclidean").collect()
    want = sorted(hierarchy.dense_tree(pairs.euclidean_distances(x, x))[2])
    assert len(got) == len(x) - 1 == len({(r["a"], r["b"]) for r in got}) and np.allclose(sorted(r["distance"] for r in got), want, atol=1e-6)
