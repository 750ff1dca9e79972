"""Similarity joins: certificate numbers by matching blocks, image hashes by Hamming.

Both are exact joins without a product of all pairs: a condition that every hit must
meet is turned into an equality, and the candidates are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.operators.lineage import cut

#: Variants of one number that are listed, at most; longer ones use pieces.
MOST_VARIANTS = 300
#: Characters from which on difflib itself compares two texts, and pairs compared at a time.
PLAIN, ROWS = 200, 4_096


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, not to be broadcast: rows that a short table is exploded to, or that compress
    well, are many more than the size of its files says."""
    return df.hint("merge")


def characters(texts: pa.Array, at: np.ndarray, length: int) -> np.ndarray:
    """A row of codes for each of the texts ``at``, which have ``length`` characters."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset)
    data = texts.buffers()[2]
    if (np.diff(ends)[at] == length).all() and data is not None:  # a byte for each
        codes = np.frombuffer(data, dtype=np.uint8)
        return codes[ends[at][:, None] + np.arange(length)[None, :]]
    return np.array(texts.take(pa.array(at)).to_pylist(), dtype=f"U{max(1, length)}").view(np.uint32).reshape(len(at), -1)[:, :length]


def matched(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of codes ``x`` and ``y`` the characters that matching blocks have: the longest
    one (the first in x, then in y), and so on to its left and to its right."""
    total = np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), ROWS):
        total[at : at + ROWS] = _matched(np.ascontiguousarray(x[at : at + ROWS].T), np.ascontiguousarray(y[at : at + ROWS].T))
    return total


def _matched(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same of columns; a round takes the longest block of all stretches that are left."""
    n, total = x.shape[1], np.zeros(x.shape[1], dtype=np.int64)
    row = np.arange(n)
    low, start = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    high, end = np.full(n, len(x), dtype=np.uint8), np.full(n, len(y), dtype=np.uint8)
    places = np.arange(len(y))[:, None]
    cells = len(x) * len(y)
    kind = np.uint16 if cells * (1 + min(len(x), len(y))) < 1 << 16 else np.uint32
    while len(row):
        left, right = (x, y) if len(row) == n and total.max(initial=0) == 0 else (x[:, row], y[:, row])
        inside = ((places >= start) & (places < end)).view(np.uint8)
        run, found = np.zeros((len(y) + 1, len(row)), dtype=np.uint8), np.zeros(len(row), dtype=kind)
        for i in range(int(low.min()), int(high.max())):
            same = (right == left[i]).view(np.uint8)
            same &= inside
            same &= ((low <= i) & (i < high)).view(np.uint8)
            np.multiply(run[:-1] + np.uint8(1), same, out=run[1:])
            # the length of a block before the place where it ends, the earlier the greater
            ended = run[1:] * kind(cells)
            ended += (cells - 1 - i * len(y) - places).astype(kind)
            np.maximum(found, ended.max(axis=0), out=found)
        best, place = (found // kind(cells)).astype(np.uint8), cells - 1 - (found % kind(cells)).astype(np.int64)
        at, to = ((v + 1 - best).astype(np.uint8) for v in np.divmod(place, len(y)))
        total += np.bincount(row, best, n).astype(np.int64)
        # what is left on a side if both have something there that may be equal
        before, after = (best > 0) & (at > low) & (to > start), (best > 0) & (at + best < high) & (to + best < end)
        row, low, high, start, end = (
            np.concatenate([u[before], v[after]]) for u, v in ((row, row), (low, at + best), (at, high), (start, to + best), (to, end))
        )
        alone = (high - low == 1) & (end - start == 1)
        if alone.any():
            total += np.bincount(row[alone], x[low[alone], row[alone]] == y[start[alone], row[alone]], n).astype(np.int64)
            row, low, high, start, end = (v[~alone] for v in (row, low, high, start, end))
    return total


def twice(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether numbers of one length that become equal by a deletion each do so in another way,
    too: what differs is one step left, and one step right, of what the other has there."""
    differ = x != y
    places = np.arange(x.shape[1] - 1)
    first, last = differ.argmax(axis=1)[:, None], x.shape[1] - 1 - differ[:, ::-1].argmax(axis=1)[:, None]
    beside = (places < first) | (places >= last)
    return (first < last)[:, 0] & ((x[:, 1:] == y[:, :-1]) | beside).all(axis=1) & ((x[:, :-1] == y[:, 1:]) | beside).all(axis=1)


def ratios(a: pa.Array, b: pa.Array, late: pa.Array) -> pa.Array:
    """Twice the matched characters over all characters (Ratcliff and Obershelp), as difflib has it.

    Where ``late``, null for a pair of numbers that meets elsewhere as well.
    """
    out, skipped = np.zeros(len(a)), np.zeros(len(a), dtype=bool)
    pairs = np.left_shift(pc.utf8_length(a).to_numpy(zero_copy_only=False).astype(np.int64), 32) + pc.utf8_length(b).to_numpy(zero_copy_only=False)
    late = late.to_numpy(zero_copy_only=False)
    for pair in np.unique(pairs).tolist():
        at, (la, lb) = np.flatnonzero(pairs == pair), divmod(pair, 1 << 32)
        if max(la, lb) >= PLAIN:  # difflib leaves out frequent characters of long texts
            out[at] = [SequenceMatcher(None, x, y).ratio() for x, y in zip(a.take(pa.array(at)).to_pylist(), b.take(pa.array(at)).to_pylist())]
        elif la and lb:
            x, y = characters(a, at, la), characters(b, at, lb)
            out[at] = 2.0 * matched(x, y) / (la + lb)
            if la == lb > 1:
                skipped[at] = late[at] & twice(x, y)
        else:
            out[at] = float(la == lb)
    return pa.array(out, mask=skipped)


ratio = F.arrow_udf(ratios, T.DoubleType())


def length_bounds(l1: int, l2: int, threshold: float) -> tuple[int, int] | None:
    """Characters to leave out of the shorter and the longer so that a hit can be equal.

    A ratio of ``threshold`` needs matched characters M >= threshold * (l1 + l2) / 2,
    which form a common subsequence: l1 - M and l2 - M are left out. None: no hit.
    """
    least = -int(-(threshold * (l1 + l2) / 2) // 1) if threshold * (l1 + l2) / 2 % 1 else int(threshold * (l1 + l2) / 2)
    if least > l1 or l2 - l1 > l2 * (1 - threshold) + 1:
        return None
    return l1 - least, l2 - least


def deletions(text: str, n: int) -> set[str]:
    return {"".join(c for i, c in enumerate(text) if i not in gone) for gone in map(set, combinations(range(len(text)), n))}


def similar_numbers(numbers: DataFrame, threshold: float) -> DataFrame:
    """(id1, no1, id2, no2, similarity) of records whose different numbers are alike.

    ``numbers``: entity_id, cert_no. The shorter number is the first, the smaller id on
    equal lengths, as the ratio depends on the order. Numbers are joined on their length
    pair and what is left after deletions; long ones on pieces that a hit leaves intact.
    Where a deletion each is enough, records of a number that at most two have travel as they
    are and pairs meet once, so that nothing is dealt out after the join; pairs with a number
    of more records, and long ones, are pairs of numbers until they are verified.
    """
    counted = cut(numbers.groupBy(F.col("cert_no").alias("no")).agg(F.length("cert_no").alias("l"), F.min("entity_id").alias("low"), F.max("entity_id").alias("high"), F.count(F.lit(1)).alias("n")))
    # one number for each length that occurs
    known = {r["l"]: r["most"] for r in counted.groupBy("l").agg(F.max("n").alias("most")).collect()}
    lengths = sorted(known)
    bounds = {(l1, l2): b for l1 in lengths for l2 in lengths if l1 <= l2 and (b := length_bounds(l1, l2, threshold)) is not None}
    single = {pair: b for pair, b in bounds.items() if max(b) <= 1}
    direct, candidates = None, by_pieces(counted, {pair: b for pair, b in bounds.items() if pair not in single})
    for (l1, l2), (d1, d2) in single.items():
        if l1 == l2 and not d1:
            continue  # only equal numbers
        met = by_deletions(counted, l1, d1, l2, d2)
        found = met.where("id1 < id2" if l1 == l2 else "id1 is not null and id2 is not null").select("id1", "no1", "id2", "no2", "late")
        direct = found if direct is None else direct.union(found)
        if max(known[l1], known[l2]) > 2:
            candidates = candidates.union(met.where("id1 is null or id2 is null").select("no1", "no2"))
    first = numbers.select(F.col("entity_id").alias("id1"), F.col("cert_no").alias("no1"))
    second = numbers.select(F.col("entity_id").alias("id2"), F.col("cert_no").alias("no2"))
    near = candidates.distinct().where(F.levenshtein("no1", "no2") <= F.ceil((F.length("no1") + F.length("no2")) * (1 - threshold)))
    verified = near.withColumn("similarity", ratio("no1", "no2", F.lit(False))).where(F.col("similarity") >= threshold)
    pairs = verified.join(shuffled(first), "no1").join(shuffled(second), "no2")
    ordered = (F.length("no1") < F.length("no2")) | (F.col("id1") < F.col("id2"))
    found = pairs.where(ordered).select("id1", "no1", "id2", "no2", "similarity")
    if direct is not None:
        near = direct.withColumn("similarity", ratio("no1", "no2", "late")).where(F.col("similarity") >= threshold).drop("late")
        found = near if len(single) == len(bounds) and max(known.values()) <= 2 else near.union(found)
    return found.select("id1", "no1", "id2", "no2", F.round("similarity", 6).alias("similarity"))


def by_deletions(counted: DataFrame, l1: int, d1: int, l2: int, d2: int) -> DataFrame:
    """(no1, id1, no2, id2, late) of different numbers of two lengths that are equal after one
    deletion at most on each side; the id is null where more than two records have the number.

    Two of one length may become equal in two ways: the second is ``late``, as the first number
    loses a later character than the other.
    """

    def keyed(length: int, n: int) -> DataFrame:
        no = F.col("no")
        ids = F.when(F.col("n") == 1, F.array("low")).when(F.col("n") == 2, F.array("low", "high")).otherwise(F.array(F.lit(None).cast("long")))
        rows = counted.where(F.col("l") == length).select("no", F.explode(ids).alias("id"))
        if not n:
            return rows.select("no", "id", F.lit(0).alias("at"), F.xxhash64("no").alias("key"))
        rests = [F.xxhash64(F.concat(F.substring(no, 1, i), F.substring(no, i + 2, length))) for i in range(length)]
        every = rows.select("no", "id", F.posexplode(F.array(*rests)).alias("at", "key"))
        # a run of equal characters leaves the same wherever one goes
        return every.where((F.col("at") == 0) | (F.expr("substring(no, at + 1, 1)") != F.expr("substring(no, at, 1)")))

    left = keyed(l1, d1).select("key", F.col("no").alias("no1"), F.col("id").alias("id1"), F.col("at").alias("at1"))
    right = keyed(l2, d2).select("key", F.col("no").alias("no2"), F.col("id").alias("id2"), F.col("at").alias("at2"))
    late = F.col("at1") > F.col("at2") if l1 == l2 else F.lit(False)
    return shuffled(left).join(shuffled(right), "key").where("no1 <> no2").select("no1", "id1", "no2", "id2", late.alias("late"))


def by_pieces(distinct: DataFrame, bounds: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """(no1, no2) of the pairs of lengths that need more than one deletion on a side."""

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for no in frame["no"]:
                for (l1, l2), (d1, d2) in bounds.items():
                    for short in (True, False):
                        if len(no) == (l1 if short else l2):
                            out += [(no, l1, l2, short, key) for key in keys(no, d1, d2, short)]
            yield pd.DataFrame(out, columns=["no", "l1", "l2", "short", "key"])

    if not bounds:
        return distinct.select(F.col("no").alias("no1"), F.col("no").alias("no2")).where("false")
    lengths = {n for pair in bounds for n in pair}
    keyed = distinct.where(F.col("l").isin(*lengths)).select("no").mapInPandas(variants, "no string, l1 int, l2 int, short boolean, key string")
    short = keyed.where("short").select(F.col("no").alias("no1"), "l1", "l2", "key")
    long = keyed.where("not short").select(F.col("no").alias("no2"), "l1", "l2", "key")
    return shuffled(short).join(shuffled(long), ["l1", "l2", "key"]).where("no1 <> no2").select("no1", "no2")


def keys(no: str, d1: int, d2: int, short: bool) -> list[str]:
    """Join keys of a number for one pair of lengths: what deletions leave, or pieces.

    If either side had too many variants, the shorter is cut into more pieces than
    there are edits, one of which every hit holds unchanged near its place.
    """
    l1, l2 = (len(no), len(no) - d1 + d2) if short else (len(no) - d2 + d1, len(no))
    if max(comb(l1, d1), comb(l2, d2)) <= MOST_VARIANTS:
        return list(deletions(no, d1 if short else d2))
    edits = d1 + d2
    size, more = divmod(l1, edits + 1)
    out, at = set(), 0
    for i in range(edits + 1):
        n = size + (i < more)
        if n:
            starts = [at] if short else range(max(0, at - edits), min(l2 - n, at + edits) + 1)
            out |= {f"{i}:{no[s : s + n]}" for s in starts}
        at += n
    return list(out)


def bits(left: list[Column], right: list[Column]) -> Column:
    """Differing bits of two hashes given as 64-bit words."""
    total = F.lit(0)
    for a, b in zip(left, right):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


WORDS = ("w0", "w1", "w2", "w3")


#: Classes of one band from which on it is cut into further bands.
HOT = 1_000


def dealt(places: list[int], n: int) -> list[list[int]]:
    """Places of bits dealt into ``n`` bands like cards: each has some of every part of a hash, so
    that bits that are alike in most hashes (a word's first ones) don't make up a band."""
    return [places[i::n] for i in range(n)]


def masks(places: list[int]) -> list[int]:
    """The four 64-bit words, signed, in which the bits at these places of 256 are set."""
    words = [sum(1 << p % 64 for p in places if p // 64 == w) for w in range(4)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def band_key(places: list[int]) -> Column:
    """A number that hashes have in common if they agree at all of these places."""
    return F.xxhash64(*[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(WORDS, masks(places))])


def agree(places: list[int]) -> Column:
    """Whether a0..a3 and b0..b3 do agree there."""
    differing = [F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}")).bitwiseAND(F.lit(m)) for w, m in zip(WORDS, masks(places))]
    return reduce(lambda x, y: x.bitwiseOR(y), differing) == 0


def hash_classes(hashes: DataFrame, threshold: int = 10, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of equal hashes: (c1, c2, distance) of different ones that differ in fewer than
    ``threshold`` bits, and the members (entity_id, class) of all. With a region, by region.

    A class is named by its smallest id. Classes meet in bands: two that differ in fewer bits
    than there are bands have one in common, and the first of these gives the pair. A band that
    many share is cut again: those of them that are near differ in fewer bits outside of it
    too, and share one of as many bands of the rest.
    """
    keys = [region] if region else []
    classes = cut(hashes.groupBy(*keys, *WORDS).agg(F.min("entity_id").alias("class")))
    places = dealt(list(range(256)), threshold)
    banded = classes.select(*keys, "class", *WORDS, F.posexplode(F.array(*[band_key(p) for p in places])).alias("band", "key"))
    crowded = cut(banded.groupBy(*keys, "band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).drop("n"))
    distance = bits([F.col(f"a{w}") for w in WORDS], [F.col(f"b{w}") for w in WORDS])

    def met(some: DataFrame, on: list[str]) -> DataFrame:
        """Near pairs among classes with equal ``on``, each at the first band that it shares."""
        first = F.coalesce(*[F.when(agree(p), i) for i, p in enumerate(places)])
        left = some.select(*on, F.col("class").alias("c1"), *[F.col(w).alias(f"a{w}") for w in WORDS])
        right = some.select(*on, F.col("class").alias("c2"), *[F.col(w).alias(f"b{w}") for w in WORDS])
        pairs = shuffled(left).join(shuffled(right), on).where((F.col("c1") < F.col("c2")) & (distance < threshold) & (first == F.col("band")))
        return pairs.select(*keys, "c1", "c2", distance.alias("distance"))

    on = [*keys, "band", "key"]
    if crowded.isEmpty():
        near = met(banded, on)
    else:
        rests = [dealt([p for p in range(256) if p not in held], threshold) for held in places]
        again = F.coalesce(*[F.when(F.col("band") == i, F.array(*[band_key(p) for p in rest])) for i, rest in enumerate(rests)])
        full = shuffled(banded).join(shuffled(crowded), on, "left_semi").select(*on, "class", *WORDS, F.posexplode(again).alias("band2", "key2"))
        near = met(shuffled(banded).join(shuffled(crowded), on, "left_anti"), on).unionByName(met(full, [*on, "band2", "key2"]).distinct())
    return near, hashes.join(shuffled(classes), [*keys, *WORDS]).select(*keys, "entity_id", "class")


def hash_links(hashes: DataFrame, threshold: int = 10, region: str | None = None) -> DataFrame:
    """(entity_id, class, n_links): of each hash how many others are near, copies included;
    no pair of records is made."""
    keys = [region] if region else []
    near, members = hash_classes(hashes, threshold, region)
    near, members = cut(near), cut(members)
    sizes = members.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("size"))
    ends = near.select(*keys, F.col("c1").alias("class"), F.col("c2").alias("other")).unionByName(near.select(*keys, F.col("c2").alias("class"), F.col("c1").alias("other")))
    others = shuffled(ends).join(shuffled(sizes.withColumnRenamed("class", "other")), [*keys, "other"]).groupBy(*keys, "class").agg(F.sum("size").alias("more"))
    counted = shuffled(sizes).join(shuffled(others), [*keys, "class"], "left").select(*keys, "class", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    return shuffled(members).join(shuffled(counted), [*keys, "class"]).select(*keys, "entity_id", "class", "n_links")


def similar_hashes(hashes: DataFrame, threshold: int = 10, region: str | None = None) -> DataFrame:
    """(id1, id2, distance) of hashes that differ in fewer than ``threshold`` bits.

    ``hashes``: entity_id, w0..w3 and, if named, a region within which they are held
    against each other. Classes are expanded to all pairs of their members, as issues ask
    for; ``hash_classes`` and ``hash_links`` don't.
    """
    keys = [region] if region else []
    near, members = hash_classes(hashes, threshold, region)
    classes = members.select(*keys, F.col("class").alias("c1")).distinct()
    same = classes.select(*keys, "c1", F.col("c1").alias("c2"), F.lit(0).alias("distance"))
    pairs = near.unionByName(same).join(shuffled(members.select(*keys, F.col("class").alias("c1"), F.col("entity_id").alias("x"))), [*keys, "c1"]).join(shuffled(members.select(*keys, F.col("class").alias("c2"), F.col("entity_id").alias("y"))), [*keys, "c2"])
    return pairs.where((F.col("c1") != F.col("c2")) | (F.col("x") < F.col("y"))).select(*keys, F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"), "distance")
