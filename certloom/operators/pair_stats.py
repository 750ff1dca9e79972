"""Statistics of all distances between vectors, without a table of the pairs.

What is asked for is reduced inside the task that multiplies two blocks of vectors:
extremes, sums, bins, the few least, values at a place of the order. Only such partial
results leave a task, each of a size that doesn't depend on the pairs. Blocks are written
once, so that all passes over them see the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.operators import pairs
from certloom.operators.lineage import cut

#: Bins of a pass over all distances, and distances that are sorted in one place at most.
BINS, SORTED = 1024, 65_536
#: Keys broadcast with their counts at most.
SMALL = 100_000


class Distances:
    """All distances of (entity_id, vector), each pair once."""

    def __init__(self, vectors: DataFrame, metric: str = "cosine", block: int | None = None):
        self.spark, self.measure = vectors.sparkSession, pairs.METRICS[metric]
        blocks, self.count = pairs.blocks_of(vectors.select("entity_id", "vector"), block or pairs.BLOCK)
        self.blocks = cut(blocks)

    def reduced(self, reduce: Callable[[Iterator[tuple]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """What ``reduce`` makes of a task's (ids of one block, of the other, distances).

        Within a block, a pair is there once: other places hold NaN.
        """
        measure = self.measure

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def measured() -> Iterator[tuple]:
                for frame in frames:
                    for tiles in pairs.block_tiles(frame):
                        for p, q, (ida, x), (idb, y) in tiles:
                            d = measure(x, y)
                            yield ida, idb, np.where(ida[:, None] < idb[None, :], d, np.nan) if p == q else d

            yield from reduce(measured())

        return pairs.meet(self.blocks, self.count).mapInPandas(run, schema)

    def extent(self) -> tuple[int, float | None, float | None, float]:
        """(pairs, least, greatest, sum)."""

        def reduce(measured: Iterator[tuple]) -> Iterator[pd.DataFrame]:
            for _, _, d in measured:
                d = d[~np.isnan(d)]
                if len(d):
                    yield pd.DataFrame({"n": [len(d)], "low": [d.min()], "high": [d.max()], "total": [d.sum()]})

        r = self.reduced(reduce, "n long, low double, high double, total double").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")).first()
        return r["n"] or 0, r["low"], r["high"], r["total"] or 0.0

    def histogram(self, bins: int = 20) -> DataFrame:
        """(bin, low, high, count) over equal widths; the largest value is in the last bin."""
        n, x, y, _ = self.extent()
        if not n:
            return self.spark.createDataFrame([], "bin int, low double, high double, count long")
        width = (y - x) / bins or 1.0

        def reduce(measured: Iterator[tuple]) -> Iterator[pd.DataFrame]:
            counts = np.zeros(bins, dtype=np.int64)
            for _, _, d in measured:
                place = np.floor((d[~np.isnan(d)] - x) / width).astype(np.int64)
                counts += np.bincount(np.clip(place, 0, bins - 1), minlength=bins)
            yield pd.DataFrame({"bin": np.arange(bins, dtype=np.int32), "count": counts})

        counted = self.reduced(reduce, "bin int, count long").groupBy("bin").agg(F.sum("count").alias("count"))
        return counted.select("bin", (x + F.col("bin") * width).alias("low"), (x + (F.col("bin") + 1) * width).alias("high"), "count")

    def least(self, k: int, greatest: bool = False) -> DataFrame:
        """(a, b, distance) of the k pairs nearest to each other (or farthest apart), ties by ids."""

        def reduce(measured: Iterator[tuple]) -> Iterator[pd.DataFrame]:
            kept = pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64), "distance": np.zeros(0)})
            for ida, idb, d in measured:
                keys = np.where(np.isnan(d), np.inf, -d if greatest else d)
                limit = np.partition(keys, k - 1, axis=None)[k - 1] if keys.size > k else np.inf
                i, j = np.nonzero((keys <= limit) & ~np.isnan(d))
                new = pd.DataFrame({"a": np.minimum(ida[i], idb[j]), "b": np.maximum(ida[i], idb[j]), "distance": d[i, j]})
                kept = pd.concat([kept, new]).sort_values(["distance", "a", "b"], ascending=[not greatest, True, True]).head(k)
            yield kept

        order = F.desc("distance") if greatest else F.asc("distance")
        return self.reduced(reduce, "a long, b long, distance double").orderBy(order, "a", "b").limit(k)

    def at(self, positions: list[int]) -> dict[int, float]:
        """The distances at 0-based places of their ascending order.

        A pass counts the values between two known ones in bins, and the bin that holds the
        place is taken apart by the next, until it holds one value only or few enough to sort.
        """
        n, low, high, _ = self.extent()
        wanted = {p: (low, high, 0, n) for p in positions if 0 <= p < n}
        done: dict[int, float] = {}
        while wanted:
            for p, (x, y, before, held) in list(wanted.items()):
                if x == y:
                    done[p] = x
                elif held <= SORTED:
                    done[p] = self._between(x, y)[p - before]
            wanted = {p: w for p, w in wanted.items() if p not in done}
            if wanted:
                spans = sorted({(x, y) for x, y, _, _ in wanted.values()})
                bins = self._bins(spans)
                for p, (x, y, before, _) in list(wanted.items()):
                    for lowest, highest, count in bins[spans.index((x, y))]:
                        if p < before + count:
                            wanted[p] = (lowest, highest, before, count)
                            break
                        before += count
        return done

    def _between(self, x: float, y: float) -> np.ndarray:
        def reduce(measured: Iterator[tuple]) -> Iterator[pd.DataFrame]:
            for _, _, d in measured:
                yield pd.DataFrame({"distance": d[(d >= x) & (d <= y)]})

        return np.sort([r["distance"] for r in self.reduced(reduce, "distance double").collect()])

    def _bins(self, spans: list[tuple[float, float]]) -> list[list[tuple[float, float, int]]]:
        """(least, greatest, number) of the values in each bin of each span that holds some."""

        def reduce(measured: Iterator[tuple]) -> Iterator[pd.DataFrame]:
            shape = (len(spans), BINS)
            counts, lows, highs = np.zeros(shape, dtype=np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
            for _, _, d in measured:
                for s, (x, y) in enumerate(spans):
                    v = d[(d >= x) & (d <= y)]
                    place = np.minimum((v - x) / (y - x) * BINS, BINS - 1).astype(np.int64)
                    counts[s] += np.bincount(place, minlength=BINS)
                    np.minimum.at(lows[s], place, v)
                    np.maximum.at(highs[s], place, v)
            s, b = np.nonzero(counts)
            yield pd.DataFrame({"span": s, "bin": b, "n": counts[s, b], "low": lows[s, b], "high": highs[s, b]})

        found = self.reduced(reduce, "span long, bin long, n long, low double, high double").groupBy("span", "bin").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        out: list[list] = [[] for _ in spans]
        for r in sorted(found.collect(), key=lambda r: (r["span"], r["bin"])):
            out[r["span"]].append((r["low"], r["high"], r["n"]))
        return out


def between_groups(items: DataFrame, metric: str = "cosine", block: int | None = None) -> DataFrame:
    """(label1, label2, pairs, least, greatest, mean) of the distances within and between
    labels. ``items``: entity_id, vector, label; rows without a label take no part."""
    measure = pairs.METRICS[metric]
    rows = items.where("label is not null").select("entity_id", "vector", "label")
    blocks, count = pairs.blocks_of(rows, block or pairs.BLOCK, "label")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tiles in pairs.block_tiles(frame, "label"):
                out = []
                for p, q, a, b in tiles:
                    (ida, x, la), (idb, y, lb) = _by_label(*a), _by_label(*b)
                    d = measure(x, y)
                    part = ida[:, None] < idb[None, :] if p == q else np.ones(d.shape, dtype=bool)
                    (ka, sa), (kb, sb) = np.unique(la, return_index=True), np.unique(lb, return_index=True)
                    per_label = lambda f, values: f.reduceat(f.reduceat(values, sa, axis=0), sb, axis=1).ravel()  # noqa: B023, E731

                    out.append(pd.DataFrame({
                        "x": np.repeat(ka, len(kb)), "y": np.tile(kb, len(ka)), "n": per_label(np.add, part.astype(np.int64)), "low": per_label(np.minimum, np.where(part, d, np.inf)),
                        "high": per_label(np.maximum, np.where(part, d, -np.inf)), "total": per_label(np.add, np.where(part, d, 0.0)),
                    }))
                    if len(out) == 64 or (p, q) == tiles[-1][:2]:
                        met = pd.concat(out).groupby(["x", "y"], as_index=False).agg({"n": "sum", "low": "min", "high": "max", "total": "sum"})
                        out = []
                        yield met[met["n"] > 0]

    partial = pairs.meet(cut(blocks), count).mapInPandas(run, "x long, y long, n long, low double, high double, total double")
    found = partial.groupBy(F.least("x", "y").alias("label1"), F.greatest("x", "y").alias("label2")).agg(F.sum("n").alias("pairs"), F.min("low").alias("least"), F.max("high").alias("greatest"), F.sum("total").alias("total"))
    return found.select("label1", "label2", "pairs", "least", "greatest", (F.col("total") / F.col("pairs")).alias("mean"))


def within_groups(items: DataFrame, metric: str = "cosine", block: int | None = None) -> DataFrame:
    """(entity_id, least, greatest, mean) of each vector's distances to others of its label;
    vectors alone in theirs are left out.

    Only blocks of one label meet, and a label has as many blocks as its size asks for. A
    task adds up what it knows of a block before it is handed on.
    """
    measure, size = pairs.METRICS[metric], block or pairs.BLOCK
    rows = items.where("label is not null").select("entity_id", "vector", "label")
    sizes = cut(rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts")))
    few = sizes.limit(SMALL + 1).count() <= SMALL
    dealt = rows.join(F.broadcast(sizes) if few else sizes, "label").withColumn("part", F.pmod(F.xxhash64("entity_id"), F.col("parts")))
    blocks = cut(dealt.groupBy("label", "part", "parts").agg(F.sort_array(F.collect_list(F.struct("entity_id", "vector"))).alias("rows")))
    left = blocks.select("label", "part", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("other"), F.col("rows").alias("a"))
    right = blocks.select("label", F.col("part").alias("other"), F.col("rows").alias("b"))
    met = left.join(right, ["label", "other"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def take(key: tuple, ids: np.ndarray, d: np.ndarray) -> None:
            n, low, high = (~np.isnan(d)).sum(axis=1), np.fmin.reduce(d, axis=1, initial=np.inf), np.fmax.reduce(d, axis=1, initial=-np.inf)
            total = np.nansum(d, axis=1)
            if key in held:
                old = held[key]
                n, low, high, total = old[1] + n, np.minimum(old[2], low), np.maximum(old[3], high), old[4] + total
            held[key] = [ids, n, low, high, total]

        def out() -> pd.DataFrame:
            columns = [np.concatenate([v[i] for v in held.values()]) for i in range(5)]
            held.clear()
            return pd.DataFrame(dict(zip(("entity_id", "n", "low", "high", "total"), columns)))

        for frame in frames:
            for label, part, other, a, b in zip(*(frame[c] for c in ("label", "part", "other", "a", "b"))):
                (ida, x), (idb, y) = pairs._matrix(a), pairs._matrix(b)
                d = measure(x, y)
                if part == other:
                    d[ida[:, None] == idb[None, :]] = np.nan
                else:
                    take((label, other), idb, d.T)
                take((label, part), ida, d)
                if len(held) > 64:
                    yield out()
        if held:
            yield out()

    partial = met.mapInPandas(run, "entity_id long, n long, low double, high double, total double")
    found = partial.groupBy("entity_id").agg(F.sum("n").alias("n"), F.min("low").alias("least"), F.max("high").alias("greatest"), F.sum("total").alias("total")).where("n > 0")
    return found.select("entity_id", "least", "greatest", (F.col("total") / F.col("n")).alias("mean"))


def _by_label(ids: np.ndarray, x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and labels of a block, by label."""
    order = np.argsort(labels, kind="stable")
    return ids[order], x[order], labels[order]
