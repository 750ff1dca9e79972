"""A stored index for exact search, one for each vector field.

Vectors are kept by the nearest of a bounded number of pivots (their cell) and by the
distance to it (``far``), sorted by both, so that the statistics of Parquet row groups and
pages tell where a ring around a pivot lies. A vector within b of a query has a distance to
any pivot that differs from the query's own by at most b (triangle inequality on unit
vectors). A search starts in the nearest cells, and the k-th best found so far bounds the
rings that are read next; the bound only falls, and the search ends when no ring is left.
Nothing is approximate: results equal those of a scan.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.config import SETTINGS, Settings
from certloom.functions.vectors import cosine
from certloom.operators.pairs import chords

#: Pivots of a field at most, and vectors for each.
PIVOTS, OF_PIVOT = 256, 512
#: Bytes of a row group, small ones being skipped more often.
ROW_GROUP = 8 * 1024 * 1024
#: What chords may be wrong by: the root of what squares of unit length are wrong by.
SLACK = 1e-6


@dataclass
class Index:
    """The index in a folder: ``vectors`` (vector_field, cell, far, entity_id, vector), and
    ``pivots`` and ``cells`` (n, low and high of ``far``), both of bounded size."""

    spark: SparkSession
    folder: str
    #: Share of the field's vectors in the rings that the last search read, and its rounds.
    share: float = field(default=0.0, init=False)
    rounds: int = field(default=0, init=False)

    @classmethod
    def build(cls, vectors: DataFrame, folder: str) -> Index:
        """Index ``vectors`` (entity_id, vector_field, vector).

        Vectors that are null, zero or hold a null or non-finite component are near nothing
        and are left out. Pivots are a sample by a hash of the ids.
        """
        index = cls(vectors.sparkSession, folder)
        rows = _usable(vectors)
        sizes = rows.groupBy("vector_field").agg(F.count(F.lit(1)).alias("n")).collect()
        pivots = []
        for name, n in sorted((r["vector_field"], r["n"]) for r in sizes):
            wanted = min(PIVOTS, math.ceil(n / OF_PIVOT))
            sample = rows.where(F.col("vector_field") == name).orderBy(F.xxhash64("entity_id", F.lit(11)), "entity_id").limit(wanted)
            for cell, r in enumerate(sample.collect()):
                v = np.asarray(r["vector"], dtype=np.float64)
                pivots.append((name, cell, (v / np.linalg.norm(v)).tolist()))
        index.spark.createDataFrame(pivots, "vector_field string, cell int, pivot array<double>").coalesce(1).write.parquet(f"{folder}/pivots")
        index.add(rows)
        return index

    def add(self, vectors: DataFrame) -> None:
        """Add vectors of indexed fields.

        The extent of the cells is written first: a failure in between leaves bounds wider
        than they need be, never too narrow.
        """
        pivots = self._pivots()

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for name, part in frame.groupby("vector_field"):
                    if name not in pivots:
                        raise ValueError(f"the index has no field {name}")
                    d = chords(np.array([np.asarray(v, dtype=np.float64) for v in part["vector"]]), pivots[name], "cosine")
                    yield part.assign(cell=d.argmin(axis=1).astype(np.int32), far=d.min(axis=1))[["vector_field", "cell", "far", "entity_id", "vector"]]

        placed = _usable(vectors).mapInPandas(place, "vector_field string, cell int, far double, entity_id long, vector array<double>")
        beside = f"{self.folder}/adding-{uuid.uuid4().hex}"
        placed.write.parquet(beside)
        placed = self.spark.read.parquet(beside)
        facts = placed.groupBy("vector_field", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
        facts.coalesce(1).write.mode("append").parquet(f"{self.folder}/cells")
        order = ("vector_field", "cell", "far")
        placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").option("parquet.block.size", ROW_GROUP).partitionBy("vector_field").parquet(f"{self.folder}/vectors")
        from certloom.operators.lineage import delete

        delete(self.spark, beside)

    def vectors(self, name: str) -> DataFrame:
        """(cell, far, entity_id, vector) of a field; other fields' files aren't listed."""
        return self.spark.read.parquet(f"{self.folder}/vectors").where(F.col("vector_field") == name).drop("vector_field")

    def search(self, name: str, vector: Sequence[float], top_k: int | None = None, exclude_self: bool = False, s: Settings = SETTINGS) -> DataFrame:
        """As ``search.search`` over the field: (entity_id, score, distance, is_abnormal),
        nearest first, ties by id. At most ``top_k`` rows of each round meet in the driver."""
        k = top_k or s.default_top_k
        query = np.asarray(vector, dtype=np.float64)
        cells = self._cells(name, query) if np.isfinite(query).all() and query.any() else []
        total, read, bound, found, at, step, self.rounds = sum(c["n"] for c in cells), 0, math.inf, [], 0, 1, 0
        while at < len(cells) and cells[at]["nearest"] <= bound + SLACK:
            chosen = []
            while at < len(cells) and cells[at]["nearest"] <= bound + SLACK and (len(chosen) < step or (math.isinf(bound) and sum(c["n"] for c in chosen) < k)):
                chosen.append(cells[at])
                at += 1
            best = self._scored(name, vector, chosen, bound)
            if exclude_self:
                best = best.where(F.col("distance") >= s.self_match_distance)
            found += [(r["entity_id"], r["score"], r["distance"]) for r in best.orderBy(F.desc("score"), "entity_id").limit(k).collect()]
            found = sorted(found, key=lambda r: (-r[1], r[0]))[:k]
            read += sum(c["n"] for c in chosen)
            if len(found) == k:
                bound = math.sqrt(max(0.0, 2 * found[-1][2]))
            step, self.rounds = step * 2, self.rounds + 1
        self.share = read / total if total else 0.0
        out = self.spark.createDataFrame(found, "entity_id long, score double, distance double").coalesce(1).orderBy(F.desc("score"), "entity_id")
        return out.withColumn("is_abnormal", F.col("score") > s.similarity_threshold)

    def within(self, name: str, vector: Sequence[float], most: float) -> DataFrame:
        """(entity_id, score, distance) of all vectors of the field within a cosine distance.

        One scan of the rings; the result stays distributed.
        """
        query, reach = np.asarray(vector, dtype=np.float64), math.sqrt(max(0.0, 2 * most))
        cells = [c for c in self._cells(name, query) if c["nearest"] <= reach + SLACK] if query.any() else []
        return self._scored(name, vector, cells, reach).where(F.col("distance") <= most)

    def ring(self, cells: list[dict], bound: float) -> Column:
        """The filter of the rings within ``bound`` of the query, pushed to the files."""
        out = F.lit(False)
        for c in cells:
            this = F.col("cell") == c["cell"]
            if not math.isinf(bound):
                this = this & (F.col("far") >= c["apart"] - bound - SLACK) & (F.col("far") <= c["apart"] + bound + SLACK)
            out = this if c is cells[0] else out | this
        return out

    def _scored(self, name: str, vector: Sequence[float], cells: list[dict], bound: float) -> DataFrame:
        query = F.array(*[F.lit(float(x)) for x in vector])
        scored = self.vectors(name).where(self.ring(cells, bound)).select("entity_id", cosine(F.col("vector"), query).alias("score"))
        return scored.withColumn("distance", 1 - F.col("score"))

    def _pivots(self) -> dict[str, np.ndarray]:
        out: dict[str, list] = {}
        for r in sorted(self.spark.read.parquet(f"{self.folder}/pivots").collect(), key=lambda r: (r["vector_field"], r["cell"])):
            out.setdefault(r["vector_field"], []).append(r["pivot"])
        return {name: np.array(rows) for name, rows in out.items()}

    def _cells(self, name: str, query: np.ndarray) -> list[dict]:
        """The cells that hold something, by the least distance that one of theirs can have."""
        pivots = self._pivots().get(name)
        if pivots is None:
            return []
        apart = chords(query[None, :], pivots, "cosine")[0]
        facts = self.spark.read.parquet(f"{self.folder}/cells").where(F.col("vector_field") == name)
        out = []
        for r in facts.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
            d = float(apart[r["cell"]])
            out.append({"cell": r["cell"], "n": r["n"], "apart": d, "nearest": max(0.0, d - r["high"], r["low"] - d)})
        return sorted(out, key=lambda c: (c["nearest"], c["apart"], c["cell"]))


def _usable(vectors: DataFrame) -> DataFrame:
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return vectors.select("entity_id", "vector_field", F.col("vector").cast("array<double>").alias("vector")).where(usable)
