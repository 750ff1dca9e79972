"""Repeated byte strings, by run-length compressed suffix indexes, and their removal.

A string of WINDOW bytes that also starts earlier (in a document before, or before in
the same one) is a repeat, and every byte that a repeat covers goes. Equal strings are
brought together without sorting all suffixes of the corpus in one place:

1. Anchors: in every window of a document the k-grams of smallest hash. Equal windows
   have equal anchors at the same places. An anchor's context is all that windows around
   it can reach. Occurrences are grouped by anchor and context; equal contexts are
   repeats of the first one as a whole.
2. Contexts that share an anchor but differ are indexed, in blocks of whole buckets:
   the Burrows-Wheeler transform of a block's contexts is kept by its runs, with samples
   at run ends. All contexts are streamed through it, backwards and side by side: within
   a run the match with the suffix above grows by a byte with every step, at the end of
   a run it is the sample. Suffixes that match over WINDOW bytes are one string, and all
   but its first occurrence are marked.
3. A bucket of more than CROWD different contexts is cut first: into pieces of a few
   windows each, which meet by all the bytes that these have in common, and, where that
   isn't enough, into single windows. So no bucket is ever gathered in one task.
4. The marked spans of a document are joined to its bytes.

Anchors and contexts are told apart by 64 bits each: two contexts of one anchor are
taken for equal wrongly with a probability of 2**-64 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.llm.common import few, text_or_empty
from certloom.llm.fill_middle import utf8_buffer
from certloom.operators.lineage import Tables, cut
from certloom.operators.order import numbered

#: Bytes of a string that counts, and of an anchor.
WINDOW, GRAM = 100, 32
#: Bytes on either side of an anchor that windows around it can reach.
REACH = WINDOW - GRAM
#: Windows of a piece, one level after the other.
LEVELS = (9, 1)
#: Different contexts of a bucket up to which it goes to a block as it is.
CROWD = 64
#: Bytes of contexts in an index, and in a task that makes one index after the other.
BLOCK_BYTES, TASK_BYTES = 250_000, 8_000_000
#: Bytes of a document of which anchors are found at once.
CHUNK = 1 << 16
#: Rows up to which spans or groups are sent to every task (about 10 MB).
BROADCAST_ROWS = 300_000
#: Groups of more than this share of the rows meet them by broadcast.
HOT_SHARE = 1000

_RANDOM = np.random.default_rng(11)
_BYTES = _RANDOM.integers(0, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RANDOM.integers(0, 2**63, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# anchors


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h = _BYTES[data]
    with np.errstate(over="ignore"):
        for level in range(GRAM.bit_length() - 1):
            h = h[: -(1 << level)] * _ODD[level] + h[1 << level :]
            h ^= h >> np.uint64(32)
        h *= _ODD[7]
        h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def sliding(x: np.ndarray, size: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) the ``size`` values from each place on."""
    width = 1
    while 2 * width <= size:
        x = of(x[:-width], x[width:])
        width *= 2
    return of(x[: len(x) - (size - width)], x[size - width :]) if width < size else x


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): the k-grams that are smallest in a window inside a document.

    ``bounds``: where documents begin and end in ``data``.
    """
    places, found = [], []
    for start in range(0, len(data), CHUNK):
        low, high = max(0, start - REACH), min(len(data), start + CHUNK + WINDOW)
        part = data[low:high]
        if len(part) < WINDOW:
            continue
        h = gram_hashes(part)
        least = sliding(h, REACH + 1, np.minimum)
        at = np.arange(low, low + len(least))
        end = bounds[np.searchsorted(bounds, at, side="right")]
        least[at + WINDOW > end] = 0  # no window of one document
        around = np.zeros(len(h) + REACH, dtype=np.uint64)
        around[REACH : REACH + len(least)] = least
        here = np.flatnonzero(sliding(around, REACH + 1, np.maximum) == h)
        here = here[(here + low >= start) & (here + low < start + CHUNK)]
        places.append(here + low)
        found.append(h[here])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(places), np.concatenate(found)


ROWS = "key long, ctx long, rid long, start int, end int, at int, last int"
_ROWS = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("at", pa.int32()), ("last", pa.int32())])


def occurrences(docs: DataFrame) -> DataFrame:
    """A row (key, ctx, rid, start, end, at, last) of every anchor of ``docs`` (rid, text).

    The context is [start, end), its anchor is ``at``. Anchors that follow each other
    byte by byte in equal contexts are one row: ``last`` is where the last one's context
    ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = utf8_buffer(batch.column(1))
            place, key = anchors(data, bounds)
            if not len(place):
                continue
            row = np.searchsorted(bounds, place, side="right") - 1
            start, end = np.maximum(place - REACH, bounds[row]), np.minimum(place + WINDOW, bounds[row + 1])
            view, digest = memoryview(data), xxhash.xxh3_64_intdigest
            ctx = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())), dtype=np.uint64, count=len(place))
            new = np.ones(len(place), dtype=bool)
            new[1:] = (np.diff(place) != 1) | (np.diff(row) != 0) | (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
            first = np.flatnonzero(new)
            last = end[np.append(first[1:], len(place)) - 1]
            base, rid = bounds[row], batch.column(0).to_numpy()[row]
            columns = [key.view(np.int64)[first], ctx.view(np.int64)[first], rid[first], *((x - base)[first] for x in (start, end, place)), last - base[first]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _ROWS)], schema=_ROWS)
        pa.default_memory_pool().release_unused()

    return docs.select("rid", "text").mapInArrow(run, ROWS)


# the index of a block


def ranks(symbols: np.ndarray, most: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Ranks of the suffixes by their first 2, 4, 8, ... symbols (by width), and the
    suffix array. ``most``: symbols within which all suffixes differ.

    A rank is the place of the first suffix with the same symbols. Only suffixes that
    still share theirs are sorted again, as numbers of two ranks and a place.
    """
    n = len(symbols)
    bits = max(n, int(symbols.max()) + 1).bit_length()
    low = np.int64((1 << bits) - 1)
    rank, by_width, width = symbols, {}, 1
    order, slots = np.arange(n), np.arange(n)
    todo = order
    while True:
        after = np.zeros(len(todo), dtype=np.int64)
        inside = todo + width < n
        after[inside] = rank[todo[inside] + width] + 1
        key = np.sort((((rank[todo] << bits) | after) << bits) | todo)
        places, pair = key & low, key >> bits
        order[slots] = places
        new = np.ones(len(pair), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(pair))
        rank = rank.copy()
        rank[places] = np.repeat(slots[first], size)
        width *= 2
        by_width[width] = rank
        shared = np.repeat(size > 1, size)
        if width >= most or not shared.any():
            return by_width, order
        todo, slots = places[shared], slots[shared]


def common_prefix(symbols: np.ndarray, by_width: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at a and b have in common; of more than 127 that many."""
    n, length = len(symbols), np.zeros(len(a), dtype=np.int64)
    a, b = a.copy(), b.copy()

    def advance(values: np.ndarray, width: int) -> None:
        inside = (a < n) & (b < n)
        same = inside & (values[np.where(inside, a, 0)] == values[np.where(inside, b, 0)])
        a[same] += width
        b[same] += width
        length[same] += width

    for width in sorted((w for w in by_width if w <= WINDOW), reverse=True):
        advance(by_width[width], width)
    for _ in range(min(by_width) - 1):
        advance(symbols, 1)
    return length


@dataclass(frozen=True)
class RunIndex:
    """A Burrows-Wheeler transform by its runs: where each begins, where its first row
    goes by one step backwards, and the samples there: how much that row has in common
    with the row above it."""

    starts: np.ndarray
    steps: np.ndarray
    samples: np.ndarray
    rows: int

    @classmethod
    def of(cls, contexts: list[bytes]) -> tuple[RunIndex, np.ndarray]:
        """The index of the contexts, and where each ends in their common text. Every
        context has an end mark of its own; the marks sort first and in order."""
        m, sizes = len(contexts), np.array([len(c) for c in contexts], dtype=np.int64)
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.empty(int(ends[-1]) + 1, dtype=np.int64)
        text = np.ones(len(symbols), dtype=bool)
        text[ends] = False
        symbols[text] = np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.int64) + m
        symbols[ends] = np.arange(m)
        by_width, order = ranks(symbols, int(sizes.max()) + 1)
        before = symbols[order - 1]  # of the first suffix the last mark
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        steps = place[order[starts] - 1]
        above = np.maximum(steps - 1, 0)
        samples = np.where(steps > 0, common_prefix(symbols, by_width, order[steps], order[above]), 0)
        return cls(starts, steps, samples, len(order)), ends

    def streamed(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, match) of every place of the contexts' text: its row in the order of
        suffixes and how much it has in common with the row above, from WINDOW on at
        least that much. All contexts are read backwards from their ends."""
        row_of, match_of = np.zeros(self.rows, dtype=np.int64), np.zeros(self.rows, dtype=np.int64)
        row_of[ends] = np.arange(len(ends))
        sizes = np.diff(ends, prepend=-1) - 1
        by_size = np.argsort(-sizes, kind="stable")
        row, place = by_size.astype(np.int64), ends[by_size].astype(np.int64)
        match, left = np.zeros(len(ends), dtype=np.int64), sizes[by_size]
        for read in range(int(left[0]) if len(left) else 0):
            active = int(np.searchsorted(-left, -read, side="left"))  # contexts longer than what is read
            row, match, place = row[:active], match[:active], place[:active] - 1
            run = np.searchsorted(self.starts, row, side="right") - 1
            inside = row - self.starts[run]
            match = np.where(inside == 0, self.samples[run], match + 1)
            row = self.steps[run] + inside
            row_of[place], match_of[place] = row, match
        return row_of, match_of


def repeated_spans(contexts: list[bytes], rids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, start, end) of the stretches of contexts that windows with an earlier equal
    in the block cover. ``rids`` and ``starts``: where each context is in the corpus."""
    index, ends = RunIndex.of(contexts)
    row_of, match_of = index.streamed(ends)
    sizes = np.diff(ends, prepend=-1) - 1
    begin = ends - sizes
    which = np.repeat(np.arange(len(contexts)), sizes + 1)
    inside = np.arange(index.rows) - begin[which]
    # one number for each place of the corpus, in its order
    reach = int((starts + sizes).max()) + 1
    real = np.unique(rids, return_inverse=True)[1][which] * reach + starts[which] + inside
    match, place = np.zeros(index.rows, dtype=np.int64), np.zeros(index.rows, dtype=np.int64)
    match[row_of], place[row_of] = match_of, real
    fresh = match < WINDOW
    fresh[0] = True
    first = np.minimum.reduceat(place, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    marked = np.flatnonzero((real > first[row_of]) & (inside + WINDOW <= sizes[which]))
    cover = np.zeros(index.rows + 1, dtype=np.int64)
    np.add.at(cover, marked, 1)
    np.add.at(cover, marked + WINDOW, -1)
    edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = which[low]
    return rids[own], starts[own] + inside[low], starts[own] + inside[low] + (high - low)


SPANS = "rid long, start int, end int"
_SPANS = pa.schema([("rid", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def indexed(contexts: DataFrame, tasks: int) -> DataFrame:
    """Spans of ``contexts`` (key, rid, start, context), by indexes of whole buckets."""

    def made(held: list[tuple]) -> pa.RecordBatch:
        found = repeated_spans([h[3] for h in held], np.array([h[1] for h in held]), np.array([h[2] for h in held], dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(found, _SPANS)], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BLOCK_BYTES and r[0] != last:
                    yield made(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
                last = r[0]
        if held:
            yield made(held)
        pa.default_memory_pool().release_unused()

    dealt = contexts.select("key", "rid", "start", "context").repartition(tasks, "key").sortWithinPartitions("key", "rid", "start")
    return dealt.mapInArrow(run, SPANS)


# buckets


def met(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` with what ``groups`` have for their keys; groups that hold many rows
    (``size`` says how many) go to every task, of which there are few."""
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), on)
    least = math.ceil(rows.count() / HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(size) > least))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(groups.where(F.col(size) <= least), on))


def by_document(docs: DataFrame, rows: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """``docs`` with the rows (rid, *columns) of each in one array, ``rows``."""
    few_rows = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    gathered = rows.groupBy("rid").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return docs.join(F.broadcast(gathered) if few_rows else gathered, "rid", how)


def with_bytes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (key, rid, start, end, at, different) with their bytes as ``context``."""
    schema = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("at", pa.int32()), ("different", pa.int64()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = memoryview(batch.column(1)[i].as_buffer())
                own = batch.column(2)[i].values
                key, start, end, at, different = (own.field(c) for c in ("key", "start", "end", "at", "different"))
                contexts = [text[a:b].tobytes() for a, b in zip(start.to_pylist(), end.to_pylist())]
                yield pa.RecordBatch.from_arrays([key, pa.array([batch.column(0)[i].as_py()] * len(own), pa.int64()), start, end, at, different, pa.array(contexts, pa.binary())], schema=schema)
        pa.default_memory_pool().release_unused()

    asked = by_document(docs.select("rid", F.col("text").cast("binary").alias("text")), rows, ["key", "start", "end", "at", "different"])
    return asked.select("rid", "text", "rows").mapInArrow(run, "key long, rid long, start int, end int, at int, different long, context binary")


def pieces(contexts: DataFrame, windows: int) -> DataFrame:
    """Rows as of ``occurrences`` for pieces of so many windows of each context; they
    meet by the bytes that all windows of the piece have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = [[] for _ in _ROWS]
            for rid, start, end, at, context in zip(*(batch.column(c).to_pylist() for c in ("rid", "start", "end", "at", "context"))):
                for low in range(-REACH, 1, windows):
                    high = min(low + windows - 1, 0)
                    a, b = max(at + low, start), min(at + high, end - WINDOW)
                    if a > b:
                        continue
                    shared = context[at + high - start : at + low + WINDOW - start]
                    key, ctx = digest(shared, seed=low - windows * 1000 & 0xFFFFFFFF), digest(context[a - start : b + WINDOW - start])
                    for column, value in zip(out, (key, ctx, rid, a, b + WINDOW, at, b + WINDOW)):
                        column.append(value)
            columns = [np.array(c, dtype=np.uint64).view(np.int64) if i < 2 else np.array(c, dtype=np.int64) for i, c in enumerate(out)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _ROWS)], schema=_ROWS)

    return contexts.mapInArrow(run, ROWS)


def found_spans(tables: Tables, docs: DataFrame) -> DataFrame:
    """(rid, start, end) of the stretches of ``docs`` (rid, text) that repeats cover."""
    rows, spans, whole = tables.keep("rows0", occurrences(docs)), [], None
    for level, windows in enumerate([*LEVELS, None]):
        # most anchors are alone in the corpus; what follows is about the rest
        again = F.max(F.col("last") > F.col("end")).alias("again")
        keys = tables.keep(f"keys{level}", rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), again).where("n > 1 or again").select("key", "n"))
        rows = tables.keep(f"shared{level}", met(rows, keys, ["key"], "n").drop("n"))
        tables.drop(f"rows{level}", f"keys{level}")
        first = F.min(F.struct("rid", "start", "end", "at"))
        counted = rows.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), first.alias("first"), again)
        groups = tables.keep(f"groups{level}", counted)
        # equal contexts: all but the first are repeats from end to end
        copied = groups.where("n > 1 or again").select("key", "ctx", "n", F.col("first.rid").alias("_rid"), F.col("first.start").alias("_start"))
        copied = tables.keep(f"copied{level}", copied)
        is_first = (F.col("rid") == F.col("_rid")) & (F.col("start") == F.col("_start"))
        copies = met(rows, copied, ["key", "ctx"], "n").where(~is_first | (F.col("last") > F.col("end")))
        spans.append(tables.keep(f"copies{level}", copies.select("rid", F.when(is_first, F.col("start") + 1).otherwise(F.col("start")).alias("start"), F.col("last").alias("end"))))
        # different contexts of one anchor: the first of each goes on
        crowds = tables.keep(f"crowds{level}", groups.groupBy("key").agg(F.count(F.lit(1)).alias("different")).where("different > 1"))
        mixed = tables.keep(f"mixed{level}", met(groups.select("key", "first"), crowds, ["key"], "different").select("key", "different", "first.*"))
        tables.drop(f"shared{level}", f"groups{level}", f"copied{level}", f"crowds{level}")
        if mixed.isEmpty():
            break
        # their bytes, from the texts or from the contexts that they are pieces of
        held = with_bytes(docs, mixed) if level == 0 else mixed.join(whole, ["rid", "at"]).withColumn("context", F.substring("whole", F.col("start") - F.col("_start") + 1, F.col("end") - F.col("start")))
        held = tables.keep(f"contexts{level}", held.select("key", "rid", "start", "end", "at", "different", "context"))
        tables.drop(f"mixed{level}")
        small, large = held.where(F.col("different") <= CROWD), held.where(F.col("different") > CROWD)
        size = small.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
        if size:
            spans.append(tables.keep(f"indexed{level}", indexed(small, max(1, math.ceil(size / TASK_BYTES), _least_tasks(docs, size)))))
        if windows is None or large.isEmpty():
            break
        if level == 0:
            whole = large.select("rid", "at", F.col("start").alias("_start"), F.col("context").alias("whole"))
        rows = tables.keep(f"rows{level + 1}", pieces(large, windows))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def _least_tasks(docs: DataFrame, size: int) -> int:
    """Tasks for the session's cores, as far as there is an index for each."""
    return min(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / BLOCK_BYTES))


def numbered_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, text): ``rid`` numbers the rows in the order of their ids.

    It is the id itself, unless ids are null or repeated: then rows are numbered, null
    ids last and rows that repeat an id in the order of their texts' MD5.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty():
        return rows.withColumn("rid", F.col("id"))
    return numbered(rows.withColumn("_md5", F.md5("text")), F.col("id").asc_nulls_last(), "_md5", name="rid").drop("_md5")


KEPT = "rid long, id long, n_bytes long, n_removed long, n_spans long, kept binary"
_KEPT = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row of ``docs``: its bytes in
    UTF-8, how many of them repeats cover, in how many runs, and the bytes that are left.

    Null texts count as empty; texts of fewer than WINDOW bytes have no repeats. Null ids
    come after all others, and rows that repeat an id are documents of their own. What is
    left is binary, as a run may begin or end within a code point. Other columns are
    ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    rows = numbered_documents(docs, id_col, text_col)
    spans = found_spans(tables, rows.select("rid", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in _KEPT]
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint8)
                own, gone, runs = batch.column(3)[i], 0, 0
                if own.is_valid:
                    cover = np.zeros(len(data) + 1, dtype=np.int32)
                    np.add.at(cover, own.values.field("start").to_numpy(), 1)
                    np.add.at(cover, own.values.field("end").to_numpy(), -1)
                    covered = np.cumsum(cover[:-1]) > 0
                    gone, runs = int(covered.sum()), int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())
                    kept = data[~covered].tobytes()
                else:
                    kept = data.tobytes()
                for column, value in zip(out, (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(data), gone, runs, kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _KEPT)], schema=_KEPT)
        pa.default_memory_pool().release_unused()

    texts = rows.select("rid", "id", F.col("text").cast("binary").alias("text"))
    joined = by_document(texts, spans, ["start", "end"], "left")
    result = cut(joined.select("rid", "id", "text", "rows").mapInArrow(run, KEPT))
    tables.drop_all()
    return result.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def kept_text(kept: Column) -> Column:
    """What is left as a string; pieces of code points become the replacement character."""
    return F.decode(kept, "UTF-8")
