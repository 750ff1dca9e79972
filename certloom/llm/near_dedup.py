"""Near-duplicate groups: banded MinHash, odd sketches, full sets, components.

1. Every text's set of five-word shingles becomes a MinHash of BANDS x ROWS samples and
   an odd sketch: a bitmap in which each sample flips one bit. Texts with equal sets are
   one class, that of the smallest id, and only classes go on.
2. Classes that agree in a band share a bucket and are candidates. All members of a
   bucket are first held against two of them (stars, so that a large group of copies
   costs as many pairs as it has members). While the pairs that are left, of members of
   one bucket in different components, are more than PAIRS_A_ROW for each member, those
   of buckets that one component dominates are held against more of its members.
3. What is left is held against each other, pair by pair, within blocks of a bucket's
   members: a task meets two blocks of at most BLOCK members at a time, and a bucket of
   any size is spread over as many tasks as it has pairs of blocks.
4. A pair survives if the set sizes allow the similarity and the odd sketches differ in
   few enough bits; for pairs across components a finer sketch decides, too. Surviving
   pairs are confirmed on the full sets of the whole texts.
5. Links become components by contracted tiles and alternating stars of nodes.

Full sets are of 64-bit shingle hashes: two of a pair's n shingles collide with a
probability below n * n / 2**65 (3e-8 for a million).
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.common import few, map_rows, text_or_empty
from certloom.operators.graph import components
from certloom.operators.lineage import Tables, cut

WORDS = 5
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: At similarity 0.75 all bands miss a pair with probability (1 - 0.75**5)**40 = 2e-5.
BANDS, ROWS = 40, 5
SKETCH_WORDS = 8
#: Samples and 64-bit words of the finer sketch of texts that share a bucket.
FINE_SAMPLES, FINE_WORDS = 2048, 48
#: Standard deviations of the sketch's estimate that a pair may be worse than the limit.
SLACK = 4.5
#: Further rounds of stars, at most; pairs for each member that call for one, and the links
#: for a member that a round must find for another.
ROUNDS, PAIRS_A_ROW, WORTHWHILE = 6, 64, 0.002
#: In further rounds stars are for buckets of which one component holds this share.
DOMINANT = 8
#: Members of a bucket that a task holds against others at once.
BLOCK = 256
#: Rows of an id or two up to which they are sent to every task (8 MB).
BROADCAST_IDS = 500_000
#: Sketches up to which they are sent to every task (10 MB).
BROADCAST_SKETCHES = 100_000
#: A class of more than this share of all rows is labelled by a broadcast of such
#: classes, of which there are fewer than the share's inverse.
HOT_SHARE = 1000
REMEMBERED = 100_000

_ODD = np.random.default_rng(2024).integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(n)
    return rng.integers(0, 2**32, size=n, dtype=np.uint64).astype(np.uint32), (rng.integers(0, 2**31, size=n, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a limit by a worker process."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


_HASHES = WordHashes()


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles of a whole text.

    Words are runs of other than ASCII white space, A-Z in lower case. With fewer than
    five words the whole sequence is the one shingle; without words there is none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        if len(words) < WORDS:
            total = np.uint64(len(words)) * _ODD[63] + (hashes * _ODD[: len(words)]).sum(dtype=np.uint64)
            return mixed(np.array([total], dtype=np.uint64))
        n = len(words) - WORDS + 1
        total = np.zeros(n, dtype=np.uint64)
        for i in range(WORDS):
            total += hashes[i : i + n] * _ODD[i]
        return np.unique(mixed(total))


def samples(hashes: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The MinHash of a set: ``n`` minima under as many permutations."""
    xor, times = permutations(n)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 256):
            part = low[at : at + 256]
            best = np.minimum(best, ((part[None, :] ^ xor[:, None]) * times[:, None]).min(axis=1))
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different from band to band."""
    with np.errstate(over="ignore"):
        rows = values.astype(np.uint64).reshape(BANDS, ROWS)
        return mixed((rows * _ODD[None, 8 : 8 + ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[20]).view(np.int64)


def odd_sketch(values: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """A bitmap in which every sample, with its number, flips one bit."""
    with np.errstate(over="ignore"):
        bits = mixed(values.astype(np.uint64) + (np.arange(len(values), dtype=np.uint64) << np.uint64(32))) % np.uint64(64 * words)
    parity = (np.bincount(bits.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def sketch_limit(k: int = BANDS * ROWS, words: int = SKETCH_WORDS) -> int:
    """Differing bits up to which sketches of k samples may belong to a linked pair."""
    n, s = 64 * words, PERCENT / 100
    differing = 2 * k * (1 - s)
    expected = n / 2 * (1 - math.exp(-2 * differing / n))
    slope = math.exp(-2 * differing / n)
    spread = math.hypot(slope * 2 * math.sqrt(k * s * (1 - s)), math.sqrt(expected * (1 - expected / n)) / math.sqrt(2))
    return math.ceil(expected + SLACK * spread)


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_hash and band keys of every text (null without words)."""

    def make():
        def step(cols):
            ids, texts = cols
            out = [[] for _ in SIGNED]
            for doc_id, text in zip(ids, texts):
                s = shingles(text)
                row = (doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(samples(s)).tolist()) if len(s) else (doc_id, 0, None, None)
                for col, value in zip(out, row):
                    col.append(value)
            return out

        return step

    return map_rows(docs, SIGNED, make)


SETS = T.StructType(
    [T.StructField("cid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("fine", T.BinaryType()), T.StructField("bands", T.BinaryType()), T.StructField("set", T.BinaryType())]
)
PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, n, sketch, fine, bands, set): size, sketches, band keys and full set of the
    named classes, from whole texts."""

    def make():
        def step(cols):
            out = [[] for _ in SETS]
            for cid, text in zip(*cols):
                s = shingles(text)
                v = samples(s)
                row = (cid, len(s), odd_sketch(v).tolist(), odd_sketch(samples(s, FINE_SAMPLES), FINE_WORDS).tobytes(), band_keys(v).tobytes(), s.tobytes()) if len(s) else (cid, 0, *[None] * 4)
                for col, value in zip(out, row):
                    col.append(value)
            return out

        return step

    texts = docs.join(few(classes, BROADCAST_IDS), docs["doc_id"] == classes["cid"]).select("cid", "text")
    return map_rows(texts, SETS, make).where("n > 0")


def differing(left: str, right: str, words: int) -> Column:
    """Bits in which two sketches, kept as arrays of words, differ."""
    total = F.bit_count(F.col(left)[0].bitwiseXOR(F.col(right)[0]))
    for i in range(1, words):
        total = total + F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i]))
    return total


def allowed(n_left: str, n_right: str) -> Column:
    """The sizes of two sets permit the similarity."""
    return F.least(n_left, n_right) * 100 >= F.greatest(n_left, n_right) * PERCENT


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that set sizes and odd sketches permit."""

    def renamed(side: str) -> DataFrame:
        return few(sets.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), BROADCAST_SKETCHES)

    met = pairs.join(renamed("a"), "a").join(renamed("b"), "b")
    return met.where(allowed("n_a", "n_b") & (differing("sketch_a", "sketch_b", SKETCH_WORDS) <= sketch_limit())).select("a", "b").distinct()


def confirmed(tables: Tables, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    pairs = tables.keep("pairs", pairs)
    wanted = tables.keep("wanted", pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
    sets = sets.select("cid", "set").join(few(wanted, BROADCAST_IDS), "cid", "left_semi")
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b")

    def check():
        def step(cols):
            keep = []
            for a, b, x, y in zip(*cols):
                n = (len(x) + len(y)) // 8
                common = n - len(np.union1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)))
                if 100 * common >= PERCENT * (n - common):
                    keep.append((a, b))
            return [[a for a, _ in keep], [b for _, b in keep]]

        return step

    return map_rows(both.select("a", "b", "set_a", "set_b"), PAIR, check)


def labelled(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cid, label) of the members of buckets; a member without links is its own."""
    labels = few(labels.withColumnRenamed("node", "cid"), BROADCAST_IDS)
    return crowded.select("key", "cid").join(labels, "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))


def mixed_buckets(members: DataFrame) -> DataFrame:
    """Buckets of more than one component: key, size, the component that has most members
    (top), how many (n_top), and the pairs of members of different ones."""
    counted = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    size, equal = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    found = counted.groupBy("key").agg(size.alias("size"), F.max(F.struct("n", "label")).alias("top"), ((size * size - equal) / 2).cast("long").alias("pairs"))
    return found.where("pairs > 0").select("key", "size", F.col("top.label").alias("top"), F.col("top.n").alias("n_top"), "pairs")


def later_stars(members: DataFrame, buckets: DataFrame, number: int) -> DataFrame:
    """(a, b) of the members of a bucket with two of the component that dominates it, if
    of another one, in an order that changes with the number of the round."""
    ruled = buckets.where(F.col("n_top") * DOMINANT >= F.greatest("size", F.lit(2 * DOMINANT))).select("key", "top")
    inside = members.join(ruled, "key")
    hubs = inside.where("label = top").groupBy("key").agg(F.min_by("cid", F.xxhash64("cid", F.lit(number))).alias("h0"), F.min_by("cid", F.xxhash64("cid", F.lit(-number))).alias("h1"))
    return star_pairs(inside.where("label <> top").join(hubs, "key"))


def star_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each row's cid with its hubs h0 and h1."""
    met = rows.select("cid", F.explode(F.array("h0", "h1")).alias("hub")).where("cid <> hub")
    return met.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()


def sketch_rows(column: list, words: int) -> np.ndarray:
    return np.array(column, dtype=np.int64).view(np.uint64).reshape(-1, words)


def pairs_across(members: DataFrame, buckets: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) of all pairs of a bucket's members from different components that sizes
    and both sketches permit.

    The members of the largest component of a bucket go to other blocks than the rest
    and are not held against each other; a bucket of one block is left whole. A pair is
    made in the first bucket that it shares, as all that it shares hold both components.
    """
    whole = F.col("size") <= block
    rest = F.when(whole, 1).otherwise(F.ceil((F.col("size") - F.col("n_top")) / block)).cast("long")
    tops = F.when(whole, 0).otherwise(F.ceil(F.col("n_top") / block)).cast("long")
    placed = members.join(buckets, "key").withColumns({"_rest": rest, "_tops": tops, "_is_top": (F.col("label") == F.col("top")) & ~whole})
    number = F.when(F.col("_is_top"), F.col("_rest") + F.pmod(F.xxhash64("cid"), F.col("_tops"))).otherwise(F.pmod(F.xxhash64("cid"), F.col("_rest")))
    placed = placed.withColumn("own", number)
    zero = F.lit(0).cast("long")
    others = F.when(F.col("_is_top"), F.sequence(zero, F.col("_rest") - 1)).otherwise(F.sequence(zero, F.col("_rest") + F.col("_tops") - 1))
    known = sets.select("cid", "n", "sketch", "fine", "bands")
    dealt = placed.select("key", "cid", "label", "own", others.alias("others")).join(few(known, BROADCAST_SKETCHES // 10), "cid")
    dealt = dealt.select("key", F.explode("others").alias("other"), F.struct("own", "cid", "label", "n", "sketch", "fine", "bands").alias("row")).select("key", F.least("row.own", "other").alias("p"), F.greatest("row.own", "other").alias("q"), "row")
    met = dealt.groupBy("key", "p", "q").agg(F.collect_list("row").alias("rows")).select("key", "p", "q", "rows")
    coarse_limit, fine_limit = sketch_limit(), sketch_limit(FINE_SAMPLES, FINE_WORDS)

    def make():
        def step(cols):
            found = set()
            for key, p, q, rows in zip(*cols):
                left = [r for r in rows if r["own"] == p]
                right = left if p == q else [r for r in rows if r["own"] == q]
                if not left or not right:
                    continue
                x, y = ({k: np.array([r[k] for r in side]) for k in ("cid", "label", "n")} for side in (left, right))
                sx, sy = (sketch_rows([r["sketch"] for r in side], SKETCH_WORDS) for side in (left, right))
                fx, fy = (np.frombuffer(b"".join(r["fine"] for r in side), dtype=np.uint64).reshape(-1, FINE_WORDS) for side in (left, right))
                bx, by = (np.frombuffer(b"".join(r["bands"] for r in side), dtype=np.int64).reshape(-1, BANDS) for side in (left, right))
                for i in range(len(left)):
                    after = i + 1 if p == q else 0
                    low, high = np.minimum(x["n"][i], y["n"][after:]), np.maximum(x["n"][i], y["n"][after:])
                    ok = (x["label"][i] != y["label"][after:]) & (x["cid"][i] != y["cid"][after:]) & (low * 100 >= high * PERCENT)
                    ok &= np.bitwise_count(sx[i] ^ sy[after:]).sum(axis=1, dtype=np.int64) <= coarse_limit
                    js = np.flatnonzero(ok) + after
                    js = js[np.bitwise_count(fx[i] ^ fy[js]).sum(axis=1, dtype=np.int64) <= fine_limit]
                    first = (bx[i] == by[js]).argmax(axis=1)
                    js = js[bx[i][first] == key]
                    one = int(x["cid"][i])
                    found.update((min(one, j), max(one, j)) for j in y["cid"][js].tolist())
            return [[a for a, _ in found], [b for _, b in found]]

        return step

    return map_rows(met, PAIR, make).distinct()


def class_components(tables: Tables, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) of the classes that are linked. ``nodes``: cid, bands."""
    banded = nodes.select("cid", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("h0"), F.min_by("cid", F.xxhash64("cid")).alias("h1")).where("size > 1").drop("size")
    crowded = tables.keep("crowded", banded.join(hubs, "key"))
    shared = tables.keep("shared", crowded.select("cid").distinct())
    sets = tables.keep("sets", full_sets(docs, shared))

    links = tables.keep("links", confirmed(tables, plausible(star_pairs(crowded), sets), sets))
    labels = tables.keep("labels", components(links))
    worthwhile = WORTHWHILE * shared.count()
    for number in range(1, ROUNDS + 1):
        members = tables.keep("members", labelled(crowded, labels))
        buckets = tables.keep("buckets", mixed_buckets(members))
        left = buckets.agg(F.sum("pairs").alias("pairs"), F.sum("size").alias("rows")).first()
        if left["pairs"] is None:
            return labels
        links = labels.toDF("a", "b")
        if left["pairs"] <= PAIRS_A_ROW * left["rows"]:
            break
        more = tables.keep("links", confirmed(tables, plausible(later_stars(members, buckets, number), sets), sets))
        links = links.union(more)
        if number == ROUNDS or more.count() <= worthwhile:
            break
        labels = tables.keep("labels", components(links))
    # the labels of the last round do: links that it found only make components larger
    across = tables.keep("across", confirmed(tables, pairs_across(members, few(buckets, BROADCAST_IDS // 3), sets), sets))
    return components(links.union(across))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Texts without words, null and empty ones among them, are linked with nothing. Every
    row of an id that is repeated has the component of its own text. Rows with a null id
    take part in nothing and are kept (their component_id is null). An empty table gives
    no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = cut(signatures(docs))
    usable = signed.where("n > 0 and doc_id is not null")
    nodes = tables.keep("nodes", usable.groupBy("set_hash").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands")))
    labels = class_components(tables, docs, nodes.select("cid", "bands"))
    labels = few(labels.withColumnRenamed("node", "cid"), BROADCAST_IDS)
    # classes whose rows are in a component of another id
    moved = nodes.select("set_hash", "cid", "size").join(labels, "cid", "left").select("set_hash", "size", F.coalesce("label", "cid").alias("component"), "label")
    moved = cut(moved.where("size > 1 or label is not null").select("set_hash", "size", "component"))
    tables.drop_all()
    rows = with_components(signed.select("doc_id", "n", "set_hash"), moved)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def with_components(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows (doc_id, n, set_hash) with their component. A class that holds many of the
    rows is labelled by broadcast, so that no task gets all its rows."""
    own = F.coalesce("component", "doc_id").alias("component")
    usable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    plain = rows.where(~usable).select("doc_id", "n", F.col("doc_id").alias("component"))
    rows = rows.where(usable)
    small = moved.select("set_hash", "component")
    if small.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2:
        return plain.union(rows.join(F.broadcast(small), "set_hash", "left").select("doc_id", "n", own))
    hot = cut(moved.where(F.col("size") * HOT_SHARE > rows.count()).select("set_hash", "component"))
    of_hot = rows.join(F.broadcast(hot), "set_hash").select("doc_id", "n", "component")
    rest = rows.join(F.broadcast(hot), "set_hash", "left_anti").join(small, "set_hash", "left").select("doc_id", "n", own)
    return plain.union(of_hot).union(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns kept.

    All rows of an id stay if one of them does; rows with a null id stay. An empty table
    stays empty.
    """
    rows = cut(near_groups(docs, id_col, text_col).select("doc_id", "kept"))
    gone = cut(rows.where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    stays = rows.where("kept").join(few(gone, BROADCAST_IDS), F.col("doc_id") == F.col("_gone"), "left_semi").select(F.col("doc_id").alias("_gone"))
    gone = few(gone.join(few(stays, BROADCAST_IDS), "_gone", "left_anti"), BROADCAST_IDS)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
