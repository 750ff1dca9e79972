"""Nearest neighbours by inner product with an adaptive dimension scan.

Vectors get one more coordinate that makes all norms equal, so that the largest inner
product is the smallest distance, and are rotated at random. Lists around centroids,
fitted on a bounded sample, hold every vector in blocks of rows. There is one list for
about LIST vectors; beyond what the sample can fit, every coarse list is divided by
centroids of what is left after the coarse ones, so that lists stay of bounded size.

A task holds one block and one batch of queries at a time and reads a few columns of the
rotated vectors after the other: the partial distance over the columns read, scaled up,
is held against the distance to beat by a hypothesis test, and candidates that are surely
too far are abandoned. Survivors get the exact inner product of the original vectors,
summed in one order, so that equal vectors tie and batches don't matter.

The distance to beat is first that of the k-th best of the sample in the lists probed,
then that of the k-th best of the nearest list, and falls while a block is read. How many
lists are probed is measured on the sample: enough for the share RECALL of the true
neighbours of sampled queries. Queries that end with fewer than k neighbours are held
against all lists without a test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.common import cut, few
from certloom.operators.lineage import Tables

#: Vectors that the index is fitted on, at most; every vector is indexed.
SAMPLE = 8_192
#: Vectors of a list on average, and of the sample for a centroid, at least.
LIST, FOR_CENTROID = 2_048, 32
#: Vectors of a block and queries of a batch, at most on average.
BLOCK, BATCH = 2_048, 512
#: Rows of a block after which the distance to beat is looked at again.
STEP = 512
#: Columns that are read between two tests, and how surely a candidate is too far.
COLUMNS, EPSILON = 16, 2.5
#: Queries times lists that are put in order at once.
TILE = 2_000_000
#: Share of live candidates below which a tile is read pair by pair.
SPARSE = 0.2
RECALL = 0.985
NOTHING = -1e300


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    bound: float  # largest squared norm
    coarse: np.ndarray
    fine: np.ndarray  # what is added to a coarse centroid
    probes: int
    sample: np.ndarray  # original vectors, for the first distance to beat
    sample_ids: np.ndarray
    sample_lists: np.ndarray

    @property
    def n_lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def rotated(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with the coordinate that evens out norms (0 for queries), rotated."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.bound - (x * x).sum(axis=1)))
        return np.column_stack([x, rest]) @ self.rotation

    def own_list(self, x: np.ndarray) -> np.ndarray:
        """The list that holds each vector."""
        r = self.rotated(x, False)
        first = nearest_row(r, self.coarse)
        return first * len(self.fine) + nearest_row(r - self.coarse[first], self.fine)

    def order(self, q: np.ndarray) -> np.ndarray:
        """All lists for each query, nearest first."""
        centres = (self.coarse[:, None, :] + self.fine[None, :, :]).reshape(self.n_lists, -1)
        d = (centres**2).sum(axis=1)[None, :] - 2 * self.rotated(q, True) @ centres.T
        return np.argsort(d, axis=1, kind="stable")


def nearest_row(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components are finite numbers."""
    big = F.lit(float("inf"))
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= big))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest_row(x, centres)
        for j in range(k):
            own = x[near == j]
            centres[j] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
    return centres


def fit(vectors: DataFrame, k: int, sample: int = SAMPLE, recall: float = RECALL, per_list: int = LIST) -> tuple[Index, int] | None:
    """The index of the usable ``vectors`` (id, v) of the most frequent length, and how
    many these are; None without any."""
    lengths = vectors.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("bound"))
    totals = lengths.orderBy(F.desc("n"), "dim").first()
    if totals is None:
        return None
    rows = vectors.where(F.size("v") == totals["dim"]).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x, ids = np.array([r["v"] for r in rows], dtype=np.float64), np.array([r["id"] for r in rows])
    dim = x.shape[1] + 1
    rotation = np.linalg.qr(np.random.default_rng(3).standard_normal((dim, dim)))[0]
    none = np.zeros((1, dim))
    index = Index(rotation, float(totals["bound"]), none, none, 1, x, ids, np.zeros(len(x), dtype=np.int64))
    wanted, most = math.ceil(totals["n"] / per_list), max(1, len(x) // FOR_CENTROID)
    r = index.rotated(x, False)
    coarse = kmeans(r, min(wanted, most))
    fine = none if wanted <= most else kmeans(r - coarse[nearest_row(r, coarse)], min(most, math.ceil(wanted / most)))
    index = replace(index, coarse=coarse, fine=fine)
    index = replace(index, sample_lists=index.own_list(x))
    return replace(index, probes=probes_for(index, k, recall)), int(totals["n"])


def probes_for(index: Index, k: int, recall: float) -> int:
    """Lists to probe: how deep in a query's order of lists its true neighbours lie."""
    asked = np.arange(0, len(index.sample), max(1, len(index.sample) // 512))
    scores = index.sample[asked] @ index.sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-scores, axis=1)[:, : min(k, len(index.sample) - 1)]
    place = np.argsort(index.order(index.sample[asked]), axis=1)
    depth = np.sort(np.take_along_axis(place, index.sample_lists[top], axis=1).ravel())
    return int(depth[min(len(depth) - 1, int(recall * len(depth)))]) + 1 if len(depth) else index.n_lists


def scan_block(q: np.ndarray, query_ids: np.ndarray, least: np.ndarray, x: np.ndarray, ids: np.ndarray, index: Index, k: int, test: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score): the k best of a block for each query, by score and id.

    ``least``: a score that k candidates are known to reach; candidates below it are of
    no use, and so the distance that belongs to it is the one to beat.
    """
    rx, rq = index.rotated(x, False), index.rotated(q, True)
    dim, norms = rx.shape[1], (q * q).sum(axis=1)
    least = least.copy()
    best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    for at in range(0, len(x), STEP):
        rows, names = x[at : at + STEP], ids[at : at + STEP]
        beat = norms + index.bound - 2 * least + 1e-9 * (norms + index.bound)
        i, j = survivors(rq, rx[at : at + STEP], beat, dim) if test else (a.ravel() for a in np.indices((len(q), len(rows))))
        apart = names[j] != query_ids[i]
        i, j = i[apart], j[apart]
        # a quick score says which may be among the best; these get the exact one
        rough = (q @ rows.T)[i, j] if len(i) * 4 > len(q) * len(rows) else np.einsum("ij,ij->i", q[i], rows[j])
        order, place = places(np.concatenate([best[0], i]), np.concatenate([best[2], rough]))
        kth = least.copy()
        last = order[place == k - 1]
        kth[np.concatenate([best[0], i])[last]] = np.maximum(kth[np.concatenate([best[0], i])[last]], np.concatenate([best[2], rough])[last])
        useful = rough >= kth[i] - 1e-9 * (1 + np.abs(kth[i]))
        i, j = i[useful], j[useful]
        best = tuple(np.concatenate([a, b]) for a, b in zip(best, (i, names[j], inner_products(q[i], rows[j]))))
        order, place = places(best[0], best[2], best[1])
        order, place = order[place < k], place[place < k]
        best = tuple(a[order] for a in best)
        last = place == k - 1
        least[best[0][last]] = np.maximum(least[best[0][last]], best[2][last])
    return query_ids[best[0]], best[1], best[2]


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with that of y, component by component in their order: equal
    vectors have equal scores, whatever else a task holds."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        total += x[:, c] * y[:, c]
    return total


def places(query: np.ndarray, score: np.ndarray, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by query, falling score and ties, and each one's place in its query."""
    order = np.lexsort((*ties, -score, query))
    return order, np.arange(len(order)) - np.searchsorted(query[order], query[order])


def survivors(rq: np.ndarray, rx: np.ndarray, beat: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the queries and candidates that no test has abandoned.

    What is left of a distance is estimated from the columns seen; a candidate goes only
    if it is too far beyond the estimate's error. While most candidates of the tile are
    alive, a product of matrices reads the next columns of all; then pair by pair.
    """
    partial, pairs = np.zeros((len(rq), len(rx))), None
    for at in range(0, dim, COLUMNS):
        end = min(at + COLUMNS, dim)
        a, b = rq[:, at:end], rx[:, at:end]
        scale = 1.0 if end == dim else (dim / end) / (1 + EPSILON / math.sqrt(end)) ** 2
        if pairs is None:
            partial += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
            alive = partial * scale <= beat[:, None]
            if end == dim or alive.mean() < SPARSE:
                pairs = np.nonzero(alive)
                partial = partial[pairs]
        else:
            i, j = pairs
            partial = partial + ((a[i] - b[j]) ** 2).sum(axis=1)
            alive = partial * scale <= beat[i]
            pairs, partial = (i[alive], j[alive]), partial[alive]
    return pairs


PLACED = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("_query", T.BooleanType()), T.StructField("list", T.LongType())])
PROBED = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("list", T.LongType()), T.StructField("nearest", T.BooleanType()), T.StructField("least", T.DoubleType())])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, per_list: int = LIST) -> DataFrame:
    """The k candidates with the largest inner products for each query row of ``table``.

    Returns query_id, rank (from 1), vec_id and score. A query is no candidate of its
    own. Null, zero and non-finite vectors take no part, nor do rows with a null id or
    of another length than the most frequent one; ties go to the smaller id; of rows
    that repeat an id the best counts. Other columns are ignored. Without usable rows
    the result is empty.
    """
    spark = table.sparkSession
    vectors = table.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("_query"))
    fitted = fit(vectors, k, sample, per_list=per_list)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, n = fitted
    dim = index.sample.shape[1]
    shared = spark.sparkContext.broadcast(index)
    tables = Tables(spark)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2), pa.array(shared.value.own_list(x))], names=PLACED.names)

    placed = tables.keep("placed", vectors.where(F.size("v") == dim).mapInArrow(place, PLACED))
    # one number for each list; a list far above the mean (copies of one vector) has more blocks
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.count_if("_query").alias("asked")).collect()
    size = np.zeros(index.n_lists, dtype=np.int64)
    for r in sizes:
        size[r["list"]] = r["size"]
    n_queries = sum(r["asked"] for r in sizes)
    parts = spark.createDataFrame([(r["list"], math.ceil(r["size"] / BLOCK)) for r in sizes], "list long, parts long")
    dealt = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = tables.keep("blocks", dealt.groupBy("list", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        rows = max(1, TILE // index.n_lists)
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            ids = batch.column(0).to_numpy()
            q = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float64).reshape(-1, dim)
            order = index.order(q)
            # lists are probed until they hold enough candidates, empty ones not at all
            room = np.cumsum(size[order], axis=1)
            depth = np.arange(index.n_lists)[None, :]
            taken = ((depth < index.probes) | (np.roll(room, 1, axis=1) <= k) | (depth == 0)) & (size[order] > 0)
            probed = np.zeros(order.shape, dtype=bool)
            np.put_along_axis(probed, order, taken, axis=1)
            # no list is searched for less than the k-th best of the sample in the lists
            scores = np.where((index.sample_ids[None, :] == ids[:, None]) | ~probed[:, index.sample_lists], -np.inf, q @ index.sample.T)
            least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(q), -np.inf)
            least = np.where(np.isfinite(least), least, NOTHING)
            i, j = np.nonzero(taken)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), batch.column(1).take(pa.array(i)), pa.array(order[i, j]), pa.array(j == taken.argmax(axis=1)[i]), pa.array(least[i])], names=PROBED.names)

    asked = placed.where("_query").select("id", "v")
    queries = tables.keep("queries", asked.mapInArrow(probe, PROBED))
    batches = max(1, math.ceil(n_queries * index.probes / index.n_lists / BATCH))

    def scanned(queries: DataFrame, test: bool = True) -> DataFrame:
        """(query_id, vec_id, score) of the best of every block that a query meets."""

        def run(met: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in met:
                for n in range(batch.num_rows):
                    rows, asked = batch.column(0)[n].values, batch.column(1)[n].values
                    x, q = (np.frombuffer(b"".join(s.field("v").to_pylist()), dtype=np.float64).reshape(-1, dim) for s in (rows, asked))
                    ids, qid, least = rows.field("id").to_numpy(), asked.field("id").to_numpy(), asked.field("least").to_numpy()
                    found = scan_block(q, qid, least, x, ids, shared.value, k, test)
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in found], names=FOUND.names)

        grouped = queries.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        grouped = grouped.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches).cast("long"))).groupBy("list", "part", "batch").agg(F.collect_list(F.struct("id", "v", "least")).alias("queries"))
        return blocks.join(grouped, ["list", "part"]).select("rows", "queries").mapInArrow(run, FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = tables.keep("first", ranked(scanned(queries.where("nearest"))))
    reached = few(first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reached")), 100_000)
    tightened = queries.where("not nearest").join(reached, "id", "left").withColumn("least", F.greatest("least", F.coalesce("reached", "least")))
    best = tables.keep("best", ranked(first.select("query_id", "vec_id", "score").union(scanned(tightened))))
    full = best.where(F.col("rank") == min(k, n - 1)).select(F.col("query_id").alias("id"))
    short = tables.keep("short", asked.join(few(full, 100_000), "id", "left_anti").select("id", "v"))
    if not short.isEmpty():
        everywhere = short.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.n_lists - 1).cast("long")))).withColumn("least", F.lit(NOTHING))
        rest = ranked(scanned(everywhere, test=False))
        best = best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    result = cut(best)
    tables.drop_all()
    return result
