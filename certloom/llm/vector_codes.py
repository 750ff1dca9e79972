"""Vector codes by product quantisation, fitted by heap Lloyd in exact integers.

Vectors are cut into equal parts, and every part position has a codebook. A block holds a
bounded number of vectors, and for each part position and entry a heap of the parts that
belong to the entry, keyed by the slack of their bounds: the distance to the second
nearest entry less that to the nearest. When entries move, an entry's drift (its own move
and the largest move of another) adds up; only parts whose key the sum has reached may
have changed sides. They are popped and held against all entries exactly; all others stay
unseen. A heap is kept as a sorted run, of which any prefix is popped at once.

A block is one row of a table with its heaps and the sums of its entries' parts. Each
round reads that table and writes the next: blocks never move between tasks, nothing is
shuffled but the sums (numbers of parts x entries x components), and a lost executor's
blocks are read again. Codebooks, of the same size, go through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from certloom.llm.common import cut
from certloom.operators.lineage import Tables

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, at most.
BLOCK = 4096
#: Integers up to which squared distances and sums are exact in 64 bits.
LARGEST = 2**27
#: Of slack and drift, which are in floating point: what they may be wrong by.
ROUNDING, MARGIN = 1e-12, 1e-9
#: A label of more than this share of all rows meets its sum by a broadcast of such labels.
HOT_SHARE = 1000


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (n, d) to entries (k, d)."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, slack) of each part; of equally near entries the first."""
    d = squared(x, entries)
    own = d.argmin(axis=1)
    least = d[np.arange(len(x)), own]
    if len(entries) == 1:
        return own, least, np.full(len(x), np.inf)
    second = np.partition(d, 1, axis=1)[:, 1]
    return own, least, np.sqrt(second) * (1 - ROUNDING) - np.sqrt(least)


class Heaps:
    """The heaps of a block: for each part position the parts' rows, grouped by entry and
    in the order of their keys within it."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.rows, self.keys, self.counts = rows, keys, counts  # (P, n), (P, n), (P, k)

    @classmethod
    def built(cls, own: np.ndarray, keys: np.ndarray, k: int) -> Heaps:
        """From every part's entry and key, by part position and row."""
        rows, sorted_keys, counts = np.empty(own.shape, dtype=np.int32), np.empty(keys.shape), np.empty((len(own), k), dtype=np.int32)
        for p in range(len(own)):
            order = np.lexsort((keys[p], own[p]))
            rows[p], sorted_keys[p], counts[p] = order, keys[p][order], np.bincount(own[p], minlength=k)
        return cls(rows, sorted_keys, counts)

    def entries(self, p: int) -> np.ndarray:
        """The entry of each place of a part position's run."""
        return np.repeat(np.arange(self.counts.shape[1]), self.counts[p])

    def popped(self, p: int, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, entries) of the parts whose key their entry's drift has reached."""
        ends = np.cumsum(self.counts[p])
        places, entries = [], []
        for j, (start, end) in enumerate(zip(ends - self.counts[p], ends)):
            reached = drift[j] * (1 + MARGIN) + MARGIN
            n = int(np.searchsorted(self.keys[p, start:end], reached, side="right"))
            places.append(np.arange(start, start + n))
            entries.append(np.full(n, j))
        return np.concatenate(places), np.concatenate(entries)

    def pushed(self, p: int, places: np.ndarray, own: np.ndarray, keys: np.ndarray) -> None:
        """The popped parts go into the heaps of their entries with their new keys."""
        entries = self.entries(p)
        entries[places] = own
        self.keys[p, places] = keys
        order = np.lexsort((self.keys[p], entries))
        self.rows[p], self.keys[p] = self.rows[p][order], self.keys[p][order]
        self.counts[p] = np.bincount(entries, minlength=self.counts.shape[1])

    def assignment(self) -> np.ndarray:
        """(n, P): the entry of each vector's parts."""
        out = np.empty(self.rows.shape[::-1], dtype=np.int64)
        for p in range(len(self.rows)):
            out[self.rows[p], p] = self.entries(p)
        return out


def summed(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """(k, 1 + d): how many parts each entry has, and the sums of their components."""
    out = np.zeros((k, 1 + x.shape[1]), dtype=np.int64)
    np.add.at(out, own, np.column_stack([np.ones(len(x), dtype=np.int64), x]))
    return out


def drifted(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(P, k): an entry's own move and the largest move of another, for each entry."""
    moves = np.sqrt(((new - old) ** 2).sum(axis=2).astype(np.float64))
    if moves.shape[1] == 1:
        return moves
    order = np.sort(moves, axis=1)
    return moves + np.where(moves == order[:, -1:], order[:, -2:-1], order[:, -1:])


BLOCKS = T.StructType(
    [T.StructField("x", T.BinaryType()), T.StructField("rows", T.BinaryType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("rescanned", T.LongType())]
)


def integers(vector: Column, scale: int) -> Column:
    """Components as integers; null where the vector takes no part."""
    big = F.lit(float(LARGEST))
    scaled = F.transform(vector.cast("array<double>"), lambda x: x * scale)
    bad = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= big))
    return F.when(F.coalesce(~bad, F.lit(False)), F.transform(scaled, lambda x: F.floor(x).cast("int")))


class Codes:
    """Codes of the rows of a table: ``rows`` (id, label, code, error) and ``codebooks`` (P, k, d)."""

    def __init__(self, rows: DataFrame, codebooks: np.ndarray, rescanned: list[int]):
        self.rows, self.codebooks, self.rescanned = rows, codebooks, rescanned

    def codebooks_sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def encode(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> Codes:
    """Codebooks fitted on all vectors, and every vector's code and error.

    Components become floor(``scale`` * x). Each position's codebook begins as that part
    of the ``entries`` smallest ids (of all, if there are fewer; rows that repeat an id by
    their components, null ids last). A round assigns every part to the nearest entry
    (squared distance, ties to the lower) and replaces entries by the floor of their
    parts' means; unused ones stay. Rows take no part and are left out if their vector is
    null, empty or holds a null or non-finite component, or one of LARGEST or more after
    scaling; or if its length isn't the most frequent one that ``parts`` divides. The
    code has two hex digits a part. Other columns are ignored; without rows the codebooks
    are empty.
    """
    spark = table.sparkSession
    tables = Tables(spark)
    label_type = table.schema[label_col].dataType
    vectors = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), integers(F.col(vector_col), scale).alias("v")).where("v is not null")
    lengths = vectors.groupBy(F.size("v").alias("dim")).count().where((F.col("dim") > 0) & (F.col("dim") % parts == 0))
    usual = lengths.orderBy(F.desc("count"), "dim").first()
    none = spark.createDataFrame([], T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    if usual is None:
        return Codes(none, np.zeros((parts, 0, 0), dtype=np.int64), [])
    dim = usual["dim"]
    width = dim // parts
    vectors = vectors.where(F.size("v") == dim)
    first = vectors.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    k = len(first)

    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label_type)), *BLOCKS])
    arrow = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(to_arrow_type(label_type))), ("x", pa.binary()), ("rows", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("sums", pa.list_(pa.int64())), ("rescanned", pa.int64())])

    def listed(x: pa.Array, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind.value_type)).cast(kind)

    def row(ids: pa.Array, labels: pa.Array, x: np.ndarray, heaps: Heaps, sums: np.ndarray, rescanned: int) -> pa.RecordBatch:
        data = [pa.array([a.tobytes()], pa.binary()) for a in (x, heaps.rows, heaps.keys, heaps.counts)]
        return pa.RecordBatch.from_arrays([listed(ids, arrow.field("ids").type), listed(labels, arrow.field("labels").type), *data, pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([rescanned])], schema=arrow)

    def part(x: np.ndarray, p: int) -> np.ndarray:
        return x[:, p * width : (p + 1) * width].astype(np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a task's vectors with their first heaps and sums."""

        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            x = whole.column(2).chunk(0).flatten().to_numpy().reshape(-1, dim)
            found = [nearest(part(x, p), books[p]) for p in range(parts)]
            own, keys = np.stack([f[0] for f in found]), np.stack([f[2] for f in found])
            sums = np.stack([summed(part(x, p), own[p], k) for p in range(parts)])
            return row(whole.column(0).chunk(0), whole.column(1).chunk(0), x.astype(np.int32), Heaps.built(own, keys, k), sums, len(x) * parts)

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                now = batch.slice(0, block - n)
                batch = batch.slice(now.num_rows)
                held.append(now)
                n += now.num_rows
                if n == block:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)

    def read(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, Heaps, np.ndarray]:
        x = np.frombuffer(batch.column("x")[i].as_py(), dtype=np.int32).reshape(-1, dim)
        shape = (parts, len(x))
        heaps = Heaps(*(np.frombuffer(batch.column(c)[i].as_py(), dtype=t).reshape(s).copy() for c, t, s in (("rows", np.int32, shape), ("keys", np.float64, shape), ("counts", np.int32, (parts, k)))))
        return x, heaps, np.array(batch.column("sums")[i].as_py(), dtype=np.int64).reshape(parts, k, 1 + width)

    def step(books: np.ndarray, drift: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x, heaps, sums = read(batch, i)
                    rescanned = 0
                    for p in range(parts):
                        places, before = heaps.popped(p, drift[p])
                        if not len(places):
                            continue
                        rescanned += len(places)
                        own_x = part(x, p)[heaps.rows[p, places]]
                        own, _, slack = nearest(own_x, books[p])
                        moved = own != before
                        sums[p] += summed(own_x[moved], own[moved], k) - summed(own_x[moved], before[moved], k)
                        heaps.pushed(p, places, own, slack + drift[p][own])
                    yield row(batch.column("ids")[i].values, batch.column("labels")[i].values, x, heaps, sums, rescanned)

        return run

    def updated(books: np.ndarray, state: DataFrame) -> tuple[np.ndarray, int]:
        """The codebooks after a round, and how many parts it has looked at."""
        numbers = state.select(F.posexplode("sums").alias("at", "sum")).groupBy("at").agg(F.sum("sum").alias("sum")).collect()
        flat = np.zeros(parts * k * (1 + width), dtype=np.int64)
        for r in numbers:
            flat[r["at"]] = r["sum"]
        total = flat.reshape(parts, k, 1 + width)
        count = total[:, :, :1]
        new = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)
        return new, int(state.agg(F.sum("rescanned")).first()[0] or 0)

    state = tables.keep("blocks", vectors.mapInArrow(placed, schema))
    drift, rescanned = np.zeros((parts, k)), []
    for _ in range(rounds):
        new, seen = updated(books, state)
        rescanned.append(seen)
        drift = drift + drifted(books, new)
        books = new
        state = tables.keep("blocks", state.mapInArrow(step(books, drift), schema))

    coded = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded_arrow = pa.schema([("id", pa.int64()), ("label", to_arrow_type(label_type)), ("code", pa.string()), ("error", pa.int64())])
    last = books

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, heaps, _ = read(batch, i)
                own = heaps.assignment()
                error = np.zeros(len(x), dtype=np.int64)
                for p in range(parts):
                    error += ((part(x, p) - last[p][own[:, p]]) ** 2).sum(axis=1)
                names = [bytes(r).hex() for r in own.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(names, pa.string()), pa.array(error)], schema=coded_arrow)

    rows = cut(state.mapInArrow(codes, coded))
    rescanned.append(int(state.agg(F.sum("rescanned")).first()[0] or 0))
    tables.drop_all()
    return Codes(rows, books, rescanned)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error, the errors summed over equal labels (nulls are equal).

    Labels that hold many of the rows meet their sums by broadcast, so that no task gets
    all their rows.
    """
    sums = cut(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows")))
    least = math.ceil((sums.agg(F.sum("_rows")).first()[0] or 0) / HOT_SHARE)
    hot = F.broadcast(sums.where(F.col("_rows") > least).select(F.col("label").alias("_label"), "label_error"))
    rest = sums.where(F.col("_rows") <= least).select(F.col("label").alias("_label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    return rows.join(hot, same).drop("_label").unionByName(rows.join(hot, same, "left_anti").join(rest, same).drop("_label"))
