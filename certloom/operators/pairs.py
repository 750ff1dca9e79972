"""Distances between vectors, by blocks.

Vectors are dealt into blocks of a bounded number of rows, and blocks into groups. Each
unordered pair of groups is one row of a join, and a task multiplies two blocks at a time,
so that no vector is held against others one by one and nothing whole is sent anywhere.
A vector is sent once for each group. There are GROUPS of them until one would hold more
than MOST_BLOCKS blocks, so that what is sent grows with the vectors up to there (524,288 of
them) and as their square over 32,768 beyond.

Pairs within a radius need not all be looked at: vectors are gathered in cells around
pivots, and two cells meet only if the triangle inequality lets them hold a near pair
(cosine distances as chords between unit vectors). Of two cells that meet, a task
multiplies only the vectors that are near enough to the other cell's pivot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certloom.operators.lineage import cut

#: Vectors of a block on average.
BLOCK = 1024
#: Vectors from which on pairs within a radius are sought by cells, and pivots at most.
CELLS_FROM, PIVOTS = 4_096, 1_024
#: Groups of blocks that meet each other, blocks of one at most, and pairs that a task hands on at a time.
GROUPS, MOST_BLOCKS, HANDED = 16, 32, 50_000
#: What bounds of distances may be wrong by: roots of what squares of unit length are wrong by.
SLACK = 1e-7


def blocks_of(vectors: DataFrame, block: int = BLOCK, *more: str) -> tuple[DataFrame, int]:
    """(number, part) with the packed vectors, by id, and further numbers of each block, and how
    many blocks there are."""
    count = max(1, math.ceil(vectors.count() / block))
    row = F.struct("entity_id", "vector", *more).alias("row")
    blocks = vectors.select(F.pmod(F.xxhash64("entity_id"), F.lit(count)).alias("number"), row).groupBy("number")
    return packed(blocks.agg(F.sort_array(F.collect_list("row")).alias("rows")), "number", *more), count


def in_bytes(vectors: np.ndarray) -> bytes:
    """A matrix as bytes, as single precision where that is exact (vectors that were stored so);
    the first of eight bytes before it says how many a number has."""
    with np.errstate(over="ignore", invalid="ignore"):
        half = vectors.astype(np.float32)
    sent = half if np.array_equal(half, vectors, equal_nan=True) else vectors
    return sent.itemsize.to_bytes(8, "little") + sent.tobytes()


def of_bytes(sent: bytes, n: int) -> np.ndarray:
    """The matrix of ``n`` rows, in double precision."""
    return np.frombuffer(sent, dtype=f"f{sent[0]}", offset=8).reshape(n, -1).astype(np.float64, copy=False)


def packed(blocks: DataFrame, number: str, *more: str) -> DataFrame:
    """(number, ids, vectors and further numbers) of blocks of rows, as bytes, so that a block that
    meets many others is read as a matrix each time, without a step for each vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                parts = [(*_matrix(rows), *(np.array([r[m] for r in rows], dtype=np.int64) for m in more)) for rows in frame["rows"]]
                columns = {name: [in_bytes(p[k]) if name == "vectors" else p[k].tobytes() for p in parts] for k, name in enumerate(("ids", "vectors", *more))}
                yield pd.DataFrame({"number": frame[number].to_numpy(), **columns})

    schema = ", ".join(["number long", *(f"{name} binary" for name in ("ids", "vectors", *more))])
    return blocks.select(number, "rows").mapInPandas(run, schema)


def group_size(count: int, groups: int = GROUPS, most: int = MOST_BLOCKS) -> int:
    """Blocks of a group: as many as give so many groups, ``most`` at most."""
    return max(1, min(most, count // groups))


def meet(blocks: DataFrame, count: int) -> DataFrame:
    """(same, a, b): all unordered pairs of groups of ``count`` blocks, ``same`` where both are one.

    Blocks travel in groups: one is sent once for every group, not for every block, and there
    are few groups. ``block_tiles`` takes the pairs of blocks out of a row.
    """
    size = group_size(count)
    groups = math.ceil(count / size)
    grouped = blocks.withColumn("group", F.expr(f"number div {size}"))
    met = blocks.sparkSession.range(groups).select(F.col("id").alias("x"), F.explode(F.sequence(F.col("id"), F.lit(groups - 1).cast("long"))).alias("y"))
    return groups_met(grouped, met, groups * (groups + 1) // 2)


def groups_met(grouped: DataFrame, met: DataFrame, n: int) -> DataFrame:
    """(same, a, b) of the ``n`` pairs (x, y) of groups; each pair is dealt by itself, so that
    tasks get equal shares."""
    kinds = [c for c in grouped.columns if c != "group"]
    groups = cut(grouped.groupBy("group").agg(F.sort_array(F.collect_list(F.struct(*kinds))).alias("blocks")))
    tasks = max(1, min(n, 8 * grouped.sparkSession.sparkContext.defaultParallelism))
    left = groups.join(F.broadcast(met), F.col("group") == F.col("x")).select("x", "y", F.col("blocks").alias("a")).repartition(tasks, "x", "y")
    right = groups.join(F.broadcast(met), F.col("group") == F.col("y")).select("x", "y", F.col("blocks").alias("b")).repartition(tasks, "x", "y")
    return left.hint("merge").join(right, ["x", "y"]).select((F.col("x") == F.col("y")).alias("same"), "a", "b")


def unpacked(block, *more: str) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(block["ids"], dtype=np.int64)
    return ids, of_bytes(block["vectors"], len(ids)), *(np.frombuffer(block[m], dtype=np.int64) for m in more)


def block_tiles(frame: pd.DataFrame, *more: str) -> Iterator[list[tuple]]:
    """Of each pair of groups the pairs of their blocks: (number, other, content, content), each
    unordered pair once, number <= other."""
    for same, a, b in zip(frame["same"], frame["a"], frame["b"]):
        left = [(int(x["number"]), unpacked(x, *more)) for x in a]
        right = left if same else [(int(x["number"]), unpacked(x, *more)) for x in b]
        yield [(p, q, x, y) for p, x in left for q, y in right if p <= q]


def block_pairs(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(same, a, b): all unordered pairs of groups of blocks, each an array of packed blocks."""
    return meet(*blocks_of(vectors, block))


def found_pairs(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b, d = (np.concatenate([f[k] for f in found]) for k in range(3))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": d})


def handed(found: list[tuple], shortest: bool, over: bool) -> Iterator[pd.DataFrame]:
    """What goes on of the pairs that are ``found``; while the shortest are sought they stay, as a
    forest, until it is ``over``."""
    if shortest and found:
        found[:] = [shortest_forest(*(np.concatenate([f[k] for f in found]) for k in range(3)))]
    if found and (over or not shortest):
        yield found_pairs(found)


def shortest_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the edges (a, b) of length ``d`` those of a minimum spanning forest."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, kept = list(range(len(ids))), []
    order = np.argsort(d, kind="stable")
    for e, x, y in zip(order.tolist(), ends[order].tolist(), ends[order + len(a)].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(e)
            if len(kept) == len(ids) - 1:
                break
    kept = np.array(kept, dtype=np.int64)
    return a[kept], b[kept], d[kept]


def _matrix(rows) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["entity_id"] for r in rows], dtype=np.int64), np.array([np.asarray(r["vector"], dtype=np.float64) for r in rows])


def cosine_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        d = 1 - (x @ y.T) / np.outer(nx, ny)
    return np.where(np.isfinite(d), d, 1.0)


def euclidean_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(d, 0))


METRICS: dict[str, Callable] = {"cosine": cosine_distances, "euclidean": euclidean_distances}


class Joined:
    """The components that a task has found among the vectors of its blocks."""

    def __init__(self) -> None:
        self.of: dict[int, np.ndarray] = {}  # of each block the component of its vectors, by number
        self.n = 0

    def add(self, p: int, q: int, n: int, m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i of block p, j of block q) of n and m vectors a forest needs."""
        for block, size in ((p, n), (q, m)):
            if block not in self.of:
                self.of[block] = np.arange(self.n, self.n + size)
                self.n += size
        a, b = self.of[p][i], self.of[q][j]
        apart = np.flatnonzero(a != b)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                above = up[x]
                if above in up:
                    up[x] = up[above]
                x = above
            return x

        needed = []
        _, first = np.unique(a[apart] * np.int64(self.n) + b[apart], return_index=True)
        for e in apart[first].tolist():
            x, y = root(int(a[e])), root(int(b[e]))
            if x != y:
                up[max(x, y)] = min(x, y)
                needed.append(e)
        if up:
            to = np.arange(self.n)
            for x in up:
                to[x] = root(x)
            self.of = {k: to[v] for k, v in self.of.items()}
        return np.array(needed, dtype=np.int64)


def forest(found: tuple, joined: Joined | None, p: int, q: int, n: int, m: int, i: np.ndarray, j: np.ndarray) -> tuple:
    """Of what was found at (i, j) of a pair of blocks what goes on: all, or a forest."""
    if joined is None or not len(i):
        return found
    needed = joined.add(p, q, n, m, i, j)
    return tuple(f[needed] for f in found)


def distances(vectors: DataFrame, metric: str = "cosine", most: float | None = None, below: bool = False, joining: bool = False, shortest: bool = False) -> DataFrame:
    """(a, b, distance) of all pairs a < b, or of those within ``most``.

    ``below``: the limit itself is too far. ``joining``: only pairs whose graph has the same
    components, of each pair of groups fewer than it has vectors, so that what goes on
    grows with the vectors and not with the pairs. ``shortest``: the same for every radius
    up to ``most``: of each pair of groups a minimum spanning forest.
    """
    measure = METRICS[metric]
    if most is not None and (metric != "cosine" or most < 1) and vectors.limit(CELLS_FROM + 1).count() > CELLS_FROM:
        return Cells.of(vectors, most, metric).near(below, joining, shortest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tiles in block_tiles(frame):
                found, held, kept, joined = [], 0, 0, Joined() if joining else None
                for p, q, (ida, x), (idb, y) in tiles:
                    d = measure(x, y)
                    keep = np.ones(d.shape, dtype=bool) if most is None else (d < most if below else d <= most)
                    if p == q:
                        keep &= ida[:, None] < idb[None, :]
                    i, j = np.nonzero(keep)
                    new = forest((ida[i], idb[j], d[i, j]), joined, p, q, len(ida), len(idb), i, j)
                    if len(new[0]):
                        found.append(new)
                        held += len(new[0])
                    if held > HANDED + kept:
                        yield from handed(found, shortest, False)
                        found = found if shortest else []
                        held = kept = sum(len(f[0]) for f in found)
                yield from handed(found, shortest, True)

    return block_pairs(vectors).mapInPandas(run, "a long, b long, distance double")


def chords(x: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """Distances that keep the triangle inequality: between unit vectors for cosine."""
    if metric == "cosine":
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norms > 0, norms, 1)
    return euclidean_distances(x, pivots)


@dataclass(frozen=True)
class Cells:
    """Vectors in cells around pivots, and the pairs of cells that may hold near pairs."""

    placed: DataFrame  # entity_id, vector, cell
    meeting: np.ndarray  # whether two cells meet
    sizes: dict[int, int]
    pivots: np.ndarray
    radii: np.ndarray
    most: float
    metric: str
    skipped: float  # share of all pairs of vectors that are in cells that don't meet

    @classmethod
    def of(cls, vectors: DataFrame, most: float, metric: str = "cosine") -> Cells:
        """Pivots are a sample of a bounded number, by a hash of the ids. Zero vectors are
        near nothing within a cosine distance below 1 and are left out."""
        rows = vectors.select("entity_id", "vector")
        if metric == "cosine":
            rows = rows.where(F.exists("vector", lambda x: x != 0))
        wanted = min(PIVOTS, max(1, rows.count() // (BLOCK // 4)))
        pivots = np.array([r["vector"] for r in rows.orderBy(F.xxhash64("entity_id", F.lit(5)), "entity_id").limit(wanted).collect()], dtype=np.float64)
        if metric == "cosine" and len(pivots):
            pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), BLOCK):  # a matrix of all pivots is wide
                    part = frame.iloc[at : at + BLOCK]
                    d = chords(np.array([np.asarray(v, dtype=np.float64) for v in part["vector"]]), pivots, metric)
                    yield part.assign(cell=d.argmin(axis=1), far=d.min(axis=1))

        placed = cut(rows.mapInPandas(place, "entity_id long, vector array<double>, cell long, far double"))
        facts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
        sizes, radii = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
        for r in facts:
            sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
        reach = math.sqrt(2 * most) if metric == "cosine" else most
        i, j = np.triu_indices(len(pivots))
        apart = euclidean_distances(pivots, pivots)[i, j] if len(pivots) else np.zeros(0)
        keep = (apart - radii[i] - radii[j] <= reach + SLACK) & (sizes[i] > 0) & (sizes[j] > 0)
        together = float((sizes[i][keep] * sizes[j][keep]).sum())
        skipped = 1 - together / max(1.0, float((sizes[i] * sizes[j]).sum()))
        meeting = np.zeros((len(pivots), len(pivots)), dtype=bool)
        meeting[i[keep], j[keep]] = meeting[j[keep], i[keep]] = True
        return cls(placed.drop("far"), meeting, {k: int(n) for k, n in enumerate(sizes) if n}, pivots, radii, most, metric, skipped)

    def units(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(cell, part, unit, group) of the parts of cells, of a block's size at most on average, and
        (x, y) of the groups that meet. Cells that are near each other share a group."""
        cells = np.array(sorted(self.sizes), dtype=np.int64)
        sizes = np.array([self.sizes[c] for c in cells], dtype=np.int64)
        step = max(1, len(cells) // GROUPS)
        order = np.argsort(euclidean_distances(self.pivots[cells], self.pivots[cells[::step]]).argmin(axis=1), kind="stable") if len(cells) else cells
        parts = -(-sizes[order] // BLOCK)
        cell = np.repeat(cells[order], parts)
        weight = np.repeat(sizes[order] / np.maximum(1, parts), parts)
        most = BLOCK * group_size(math.ceil(sizes.sum() / BLOCK))
        group = ((np.cumsum(weight) - weight) // most).astype(np.int64)
        part = np.arange(len(cell)) - np.repeat(np.cumsum(parts) - parts, parts)
        units = pd.DataFrame({"cell": cell, "part": part, "unit": np.arange(len(cell)), "group": group})
        n = int(group.max()) + 1 if len(group) else 0
        held = np.zeros((n, len(self.pivots)), dtype=bool)
        held[group, cell] = True
        x, y = np.nonzero(np.triu(held.astype(np.int64) @ self.meeting.astype(np.int64) @ held.T.astype(np.int64)))
        return units, pd.DataFrame({"x": x, "y": y})

    def near(self, below: bool = False, joining: bool = False, shortest: bool = False) -> DataFrame:
        """(a, b, distance) of all pairs within the radius, a < b, or of those that join them, or
        join those within each smaller radius as well."""
        measure, most, metric, pivots, radii, meeting = METRICS[self.metric], self.most, self.metric, self.pivots, self.radii, self.meeting
        reach = math.sqrt(2 * most) if metric == "cosine" else most
        spark = self.placed.sparkSession
        units, met = self.units()
        parts = spark.createDataFrame(units.groupby("cell", as_index=False).agg(parts=("part", "size")), "cell long, parts long")
        dealt = self.placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("entity_id"), F.col("parts")))
        named = dealt.join(F.broadcast(spark.createDataFrame(units, "cell long, part long, unit long, group long")), ["cell", "part"])
        blocks = packed(named.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("entity_id", "vector"))).alias("rows")), "unit")
        grouped = blocks.join(F.broadcast(spark.createDataFrame(units[["unit", "group"]], "number long, group long")), "number")
        at_cell = units["cell"].to_numpy()

        def across(p: int, q: int, ida: np.ndarray, x: np.ndarray, idb: np.ndarray, y: np.ndarray, joined: Joined | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            cell, other = at_cell[p], at_cell[q]
            n, m = len(ida), len(idb)
            at, to = np.ones(n, dtype=bool), np.ones(m, dtype=bool)
            if cell != other:
                at, to = (chords(v, pivots[c : c + 1], metric)[:, 0] <= radii[c] + reach + SLACK for v, c in ((x, other), (y, cell)))
                ida, x, idb, y = ida[at], x[at], idb[to], y[to]
            d = measure(x, y)
            keep = d < most if below else d <= most
            if p == q:
                keep &= ida[:, None] < idb[None, :]
            i, j = np.nonzero(keep)
            return forest((ida[i], idb[j], d[i, j]), joined, p, q, n, m, np.flatnonzero(at)[i], np.flatnonzero(to)[j])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for tiles in block_tiles(frame):
                    found, held, kept, joined = [], 0, 0, Joined() if joining else None
                    for p, q, x, y in tiles:
                        if meeting[at_cell[p], at_cell[q]] and len((new := across(p, q, *x, *y, joined))[0]):
                            found.append(new)
                            held += len(new[0])
                        if held > HANDED + kept:
                            yield from handed(found, shortest, False)
                            found = found if shortest else []
                            held = kept = sum(len(f[0]) for f in found)
                    yield from handed(found, shortest, True)

        return groups_met(grouped, spark.createDataFrame(met, "x long, y long"), len(met)).mapInPandas(run, "a long, b long, distance double")


def nearer(held: tuple[np.ndarray, np.ndarray], d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids), ascending, of the nearest k that are known of each row of ``d`` and its
    columns together; ties go to the smaller id, places without any hold infinity."""
    known, who = held
    n, k = known.shape
    limit = known[:, -1]
    if np.isinf(limit).any() and d.shape[1] > k:
        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero((d <= limit[:, None]) & (d < np.inf))
    if not len(i):
        return held
    changed = np.unique(i)
    row = np.concatenate([np.repeat(changed, k), i])
    distance, other = np.concatenate([known[changed].ravel(), d[i, j]]), np.concatenate([who[changed].ravel(), ids[j]])
    order = np.lexsort((other, distance, row))
    first = np.searchsorted(row[order], changed)
    best = order[first[:, None] + np.arange(k)[None, :]]
    known[changed], who[changed] = distance[best], other[best]
    return known, who


def nearest(vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(entity_id, neighbour, distance, rank) of the k nearest others of every vector.

    Each pair of groups gives at most k candidates for each of its vectors; ties go to
    the smaller id.
    """
    measure = METRICS[metric]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tiles in block_tiles(frame):
                of: dict[int, np.ndarray] = {}
                best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for p, q, (ida, x), (idb, y) in tiles:
                    d = measure(x, y)
                    if p == q:
                        d[ida[:, None] == idb[None, :]] = np.inf
                    for at, ids, others, m in ((p, ida, idb, d), (q, idb, ida, d.T))[: 1 if p == q else 2]:
                        if at not in best:
                            of[at], best[at] = ids, (np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max))
                        best[at] = nearer(best[at], m, others)
                for at, (distance, other) in best.items():
                    i, j = np.nonzero(distance < np.inf)
                    yield pd.DataFrame({"entity_id": of[at][i], "neighbour": other[i, j], "distance": distance[i, j]})

    found = block_pairs(vectors).mapInPandas(run, "entity_id long, neighbour long, distance double")
    order = Window.partitionBy("entity_id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_of(vectors: DataFrame, targets: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(entity_id, target, distance) of the nearest target of every vector, ties to the
    smaller target. ``targets``: target, vector.

    Groups of blocks of both meet, so that a vector is sent once for each group of the other
    side, and a task holds a few groups however many pairs of blocks there are.
    """
    measure = METRICS[metric]
    (left, n), (right, count) = blocks_of(vectors), blocks_of(targets.select(F.col("target").alias("entity_id"), "vector"))
    size, other = group_size(n), group_size(count)
    first, groups = math.ceil(n / size), math.ceil(count / other)
    of_targets = right.withColumns({"number": F.col("number") + n, "group": F.expr(f"{first} + number div {other}")})
    grouped = left.withColumn("group", F.expr(f"number div {size}")).unionByName(of_targets)
    every = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + groups - 1).cast("long")))
    met = vectors.sparkSession.range(first).select(F.col("id").alias("x"), every.alias("y"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tiles in block_tiles(frame):
                best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
                for p, _, (ida, x), (idb, y) in tiles:
                    d = measure(x, y)  # blocks are in the order of their ids
                    at = d.argmin(axis=1)
                    d, target = d[np.arange(len(ida)), at], idb[at]
                    if p in best:
                        _, who, known = best[p]
                        kept = (known < d) | ((known == d) & (who < target))
                        d, target = np.where(kept, known, d), np.where(kept, who, target)
                    best[p] = ida, target, d
                for ids, target, d in best.values():
                    yield pd.DataFrame({"entity_id": ids, "target": target, "distance": d})

    found = groups_met(grouped, met, first * groups).mapInPandas(run, "entity_id long, target long, distance double")
    best = found.groupBy("entity_id").agg(F.min(F.struct("distance", "target")).alias("m"))
    return best.select("entity_id", "m.target", "m.distance")
