"""A quality classifier learned from preference pairs (Bradley-Terry).

Every labelled good text is preferred to every labelled bad one. The score of a text is
linear in its features; the chance that one text is preferred to another is the logistic
function of the difference of their scores, so the weights minimise the logistic loss on
feature differences. The cut is a quantile of the labelled rows' scores: the share of bad
texts. Scores are mapped to 0..1 so that the cut falls on a fixed value.

The model is fitted on all labelled rows. Their features are one table; every row is in
pairs, made within blocks of rows that a hash deals; each step of Newton's method adds up
gradients and curvatures of the blocks, and only such sums reach the driver. Every text
is scored, whole.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.common import cut, few, map_rows, text_or_empty
from certloom.operators.order import numbered

#: Labelled rows of a block on average, and pairs that a row of the rarer label is in, at least.
BLOCK, PAIRS = 4_096, 16
#: Labels broadcast at most; beyond it the join shuffles.
FEW = 200_000
CUT = 0.7

_LAST = 0x24F
KINDS = ("upper", "lower", "digit", "space", "line", "point", "sign", "other")


def _kind(code: int) -> int:
    c = chr(code)
    if c in "\r\n":
        return 4
    if c.isspace():
        return 3
    group = unicodedata.category(c)
    if group == "Lu":
        return 0
    if group[0] == "L":
        return 1
    if group[0] == "N":
        return 2
    return 5 if c in ".,;:?'\"-()¿¡«»" else 6 if group[0] in "PS" else 7


_TABLE = np.array([_kind(c) for c in range(_LAST + 1)] + [1], dtype=np.int64)


def features(text: str) -> np.ndarray:
    """Shares of kinds of characters and words, and of what is repeated, of a whole text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = max(1, len(codes))
    kinds = np.bincount(_TABLE[np.minimum(codes, _LAST + 1)], minlength=len(KINDS)) / n
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    same_next = sum(a == b for a, b in zip(words, words[1:])) / w
    signs = sum(not x[-1].isalnum() and x[-1] not in ".,;:?)'\"" for x in words) / w
    doubled = sum(len(x) > 2 and x[-1] == x[-2] and not x[-1].isalnum() for x in words) / w
    bare = sum(not any(map(str.isalnum, x)) for x in counts) / max(1, len(counts))
    bare_words = sum(v for x, v in counts.items() if not any(map(str.isalnum, x))) / w
    shout = sum(len(x) > 1 and x.isupper() for x in words) / w
    fives = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = [
        *kinds[[0, 2, 5, 6, 7]],
        same_next,
        signs,
        doubled,
        bare,
        bare_words,
        shout,
        1 - len(set(fives)) / max(1, len(fives)),
        1 - len(set(lines)) / max(1, len(lines)),
        max(counts.values(), default=0) / w,
    ]
    return np.array(
        [*shares, *(math.log(1e-3 + x) for x in shares), math.log1p(len(words)), math.log(max(1, len(counts))) / math.log(w + 1), math.log1p(n / w), math.log1p(w / max(1, len(lines)))],
        dtype=np.float64,
    )


N_FEATURES = len(features("a b"))


@dataclass(frozen=True)
class Ranking:
    """Weights on standardised features, and the map of scores to 0..1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.cut) / self.spread + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def differences(z: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Feature differences of pairs (good, bad): every row is in some, and those of one label in
    as many as each other, but for one; the rarer ones in PAIRS at least."""
    highs, lows = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(highs) or not len(lows):
        return np.zeros((0, z.shape[1]))
    rng = np.random.default_rng(7)
    turns = -(-max(len(highs), len(lows), PAIRS * min(len(highs), len(lows))) // min(len(highs), len(lows))) * min(len(highs), len(lows))
    return z[np.resize(rng.permutation(highs), turns)] - z[rng.permutation(np.resize(lows, turns))]


def fit(rows: DataFrame, ridge: float = 1e-2) -> Ranking:
    """Weights by Newton's method on the logistic loss of pairs (good, bad).

    ``rows``: at (a hash), good (1 or 0) and the features x of all labelled rows, a table
    that is read in each step. With rows of one label only there are no pairs: all texts then score
    above the cut (only good ones seen, or none) or below it.
    """
    total = sums(rows, lambda x, good: [[len(x), good.sum()], x.sum(axis=0)])
    n, n_good = (int(v) for v in total[0]) if total else (0, 0)
    mean = total[1] / n if n else np.zeros(N_FEATURES)
    scale = np.sqrt(sums(rows, lambda x, good: [((x - mean) ** 2).sum(axis=0)])[0] / n) + 1e-6 if n else np.ones(N_FEATURES)
    weights = np.zeros(N_FEATURES)
    if not n_good or n_good == n:
        return Ranking(mean, scale, weights, 1.0 if n > n_good else -1.0, 1.0)

    def step(weights: np.ndarray):
        def run(x: np.ndarray, good: np.ndarray) -> list:
            diff = differences(np.clip((x - mean) / scale, -8, 8), good)
            p = 1 / (1 + np.exp(np.clip(diff @ weights, -40, 40)))
            return [[len(diff)], diff.T @ p, ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()]

        return run

    blocked = in_blocks(rows, n)
    for _ in range(25):
        count, gradient, curve = sums(blocked, step(weights))
        move = np.linalg.solve(curve.reshape(N_FEATURES, -1) / count[0] + ridge * np.eye(N_FEATURES), gradient / count[0] - ridge * weights)
        weights = weights + move
        if np.abs(move).max() < 1e-8:
            break
    return Ranking(mean, scale, weights, *_cut(rows, Ranking(mean, scale, weights, 0.0, 1.0), n, n - n_good))


def _cut(rows: DataFrame, ranking: Ranking, n: int, n_bad: int) -> tuple[float, float]:
    """The quantile of all labelled rows' scores, moved to the widest gap between scores within
    one hundredth of it, and the spread: a quarter of the median distance from it."""
    schema = T.StructType([T.StructField("raw", T.DoubleType())])
    placed = numbered(map_rows(rows.select("x"), schema, lambda: lambda cols: [ranking.raw(np.array(cols[0])).tolist()]), "raw")
    # as many rows as are bad are below the cut, give or take a hundredth
    first, last = max(0, math.ceil(n_bad - 0.01 * n) - 1), min(n - 2, math.floor(n_bad + 0.01 * n) - 1)
    first, last = (first, last) if first <= last else (min(n_bad - 1, n - 2),) * 2
    near = placed.where(F.col("position").between(first, last + 1))
    gap = near.select("position", "raw").join(near.select((F.col("position") - 1).alias("position"), F.col("raw").alias("next")), "position")
    widest = gap.orderBy((F.col("raw") - F.col("next")), "position").first()
    cut_at = (widest["raw"] + widest["next"]) / 2
    far = numbered(placed.select(F.abs(F.col("raw") - cut_at).alias("far")), "far")
    middle = [r["far"] for r in far.where(F.col("position").isin((n - 1) // 2, n // 2)).collect()]
    return float(cut_at), float(max(1e-3, np.mean(middle) / 4))


def in_blocks(rows: DataFrame, n: int) -> DataFrame:
    """A row for each block of about BLOCK rows that a hash of the id deals: good and x as arrays,
    sorted, so that the pairs don't depend on how the rows arrive."""
    parts = max(1, n // BLOCK)
    row = F.struct("good", "x")
    return cut(rows.groupBy(F.pmod(F.col("at"), F.lit(parts)).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows")).select(F.col("rows.good").alias("good"), F.col("rows.x").alias("x")))


def sums(rows: DataFrame, measure) -> list[np.ndarray] | None:
    """The sums over all rows, or blocks of rows, of what ``measure`` makes of (features, good) of
    a task's batch or block; None without rows."""
    blocked = isinstance(rows.schema["good"].dataType, T.ArrayType)

    def make():
        def step(cols):
            groups = list(zip(*cols)) if blocked else [cols]
            found = [[np.asarray(v, dtype=np.float64).tolist() for v in measure(np.array(x, dtype=np.float64), np.array(good) == 1)] for good, x in groups]
            return [[f[k] for f in found for k in range(len(f))], [k for f in found for k in range(len(f))]]

        return step

    parts = map_rows(rows.select("good", "x"), T.StructType([T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("k", T.LongType())]), make)
    added = parts.select("k", F.posexplode("v").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).orderBy("k", "i").collect()
    out: dict[int, list[float]] = {}
    for r in added:
        out.setdefault(r["k"], []).append(r["v"])
    return [np.array(v) for _, v in sorted(out.items())] or None


def bucket(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``: what decides which rows are held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % of


FEATURES = T.StructType([T.StructField("at", T.LongType()), T.StructField("good", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", usable: Column | None = None) -> Ranking:
    """A ranking from all labelled rows.

    ``labels``: doc_id and the label (1 good, 0 bad; rows with another label or none are
    left out; rows that repeat an id count as often as they meet). ``usable`` says which
    rows may be learned from, by their ``_id``. Null texts count as empty; without
    labelled rows all texts pass. Other columns, whatever their names, are ignored.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label_col).cast("long").alias("_good")).where("_id is not null")
    if usable is not None:
        known = known.where(usable)

    def make():
        return lambda cols: [cols[0], cols[1], [features(t).tolist() for t in cols[2]]]

    # up to FEW labels go to every task; beyond it labels and texts meet by a shuffle
    texts = docs.select(F.col("doc_id").alias("_id"), text_or_empty().alias("text")).join(few(known, FEW), "_id").select(F.xxhash64("_id").alias("_at"), "_good", "text")
    return fit(cut(map_rows(texts, FEATURES, make)))


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0..1) and predicted (1 if the score is at least CUT) of every text.

    Null texts count as empty and get a score like any other; repeated rows are
    repeated; a null id stays null; other columns are ignored.
    """

    def make():
        def step(cols):
            return [cols[0], ranking.score(np.array([features(t) for t in cols[1]])).tolist()]

        return step

    scored = map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), SCORED, make)
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that are predicted bad; all columns, no shuffle.

    Null texts count as empty and are judged like any other; rows that repeat an id are
    judged each by its own text; an empty table stays empty.
    """

    def verdict(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = [t or "" for t in batch.column(at).to_pylist()]
            good = ranking.score(np.array([features(t) for t in texts])) >= CUT
            yield batch.filter(pa.array(good))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(verdict, docs.schema)
