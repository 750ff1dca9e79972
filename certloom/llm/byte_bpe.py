"""Byte-level BPE of whole texts by overlapping chunks, and decoding.

A long text is cut into chunks that overlap. Each chunk is split into pre-tokens on its
own, in parallel. Where the boundaries of two neighbours coincide inside their overlap
the splits have resynchronised: a match of the pattern depends only on what follows its
start, so from a shared boundary on both chains are the same. The text is cut at those
places, the pieces are encoded in parallel, and their ids are joined in order. A text
of one chunk is one piece; how many pieces a text had is reported with its digests.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.common import map_rows, text_or_empty, to_arrow

#: Code points of a chunk and of the part that it shares with the next one.
CHUNK = 8_192
OVERLAP = 256


@cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once for each worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of a text taken by itself."""
    return [m.end() for m in splitter(pattern).finditer(text)]


def encode_piece(enc: tiktoken.Encoding, text: str) -> bytes:
    return array("I", enc.encode_ordinary(text)).tobytes()


def narrow(enc: tiktoken.Encoding, ids: bytes) -> bytes:
    """The ids of a piece as they are moved: with 16 bits each if the vocabulary allows."""
    return np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if enc.n_vocab <= 1 << 16 else ids


def wide(enc: tiktoken.Encoding, ids: bytes) -> bytes:
    return np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if enc.n_vocab <= 1 << 16 else ids


def decode(enc: tiktoken.Encoding, ids: bytes) -> bytes:
    """The text's bytes: those of its ids, one after the other."""
    return enc.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
# keys are declared without nulls, so that no filter makes the plans of shared shuffles differ
CHUNKS = T.StructType(
    [T.StructField("key", T.StringType(), False), T.StructField("doc_id", T.LongType()), T.StructField("chunk", T.LongType(), False), T.StructField("at", T.LongType()), T.StructField("text", T.StringType())]
)
PARTS = ("key", "chunk", "doc_id", "at", "text", "copies")
ENDS = T.StructType(
    [T.StructField("key", T.StringType(), False), T.StructField("chunk", T.LongType(), False), T.StructField("at", T.LongType()), T.StructField("head", T.ArrayType(T.LongType())), T.StructField("tail", T.ArrayType(T.LongType()))]
)
PIECES = T.StructType([T.StructField("key", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("ids", T.BinaryType())])


def chunked(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks of texts, with a key for each different (doc_id, text)."""
    schema = to_arrow(CHUNKS)

    def run(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = f"{doc_id}:{hashlib.md5(text.encode()).hexdigest()}"
                rows = []
                for n, at in enumerate(range(0, max(1, len(text) - overlap), chunk - overlap)):
                    rows.append((key, doc_id, n, at, text[at : at + chunk]))
                    if len(rows) == 64:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return docs.mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def cut_places(parts: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """Where each chunk's own part of the text begins and ends: key, chunk, piece, own,
    until (null at the end of the text) and alone (no other chunk is in its piece).

    Only the ends of pre-tokens inside overlaps are moved, not the texts.
    """

    def mark():
        def step(cols):
            keys, chunks, _, at, texts, _ = cols
            ends = [boundaries(t, pattern) for t in texts]
            heads = [[x for x in e if x <= overlap] for e in ends]
            tails = [[x for x in e[:-2] if x >= len(t) - overlap] for e, t in zip(ends, texts)]
            return [keys, chunks, at, heads, tails]

        return step

    in_text = Window.partitionBy("key").orderBy("chunk")
    marked = map_rows(parts, ENDS, mark).withColumns({"_tail": F.lag("tail").over(in_text), "_at": F.lag("at").over(in_text)})
    # the place in the text from which a chunk takes over from the one before it
    heads = F.concat(F.array("at"), F.transform("head", lambda x: x + F.col("at")))
    tails = F.transform("_tail", lambda x: x + F.col("_at"))
    placed = marked.withColumn("own", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(F.array_max(F.array_intersect(heads, tails))))
    unproven = F.sum(F.col("own").isNull().cast("long")).over(in_text)
    placed = placed.withColumn("_unproven", unproven).withColumn("own", F.when(F.col("_unproven") == 0, F.col("own")))
    return placed.select(
        "key",
        "chunk",
        F.sum(F.col("own").isNotNull().cast("long")).over(in_text).alias("piece"),
        "own",
        F.lead("own").over(in_text).alias("until"),
        (F.col("own").isNotNull() & (F.coalesce(F.lead("_unproven").over(in_text), F.lit(0)) == 0)).alias("alone"),
    )


def encode_long(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id and parts (the ids of its pieces, in order, as ``narrow`` has them) of texts
    by chunks that are split, stitched and encoded in parallel.

    Ends of pre-tokens in the left chunk are sure but for the last two: the last touches
    the cut, and a contraction that is cut makes two. Where two neighbours share no sure
    boundary (a pre-token is longer than their overlap), the rest of the text is one
    piece, as nothing proves later boundaries.
    """

    # rows that repeat id and text are encoded once and counted
    parts = (
        chunked(docs, chunk, overlap)
        .groupBy("key", "chunk")
        .agg(F.first("doc_id").alias("doc_id"), F.first("at").alias("at"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        .select(*PARTS)
    )
    # all columns go along, so that the chunks are shuffled once for this and for encoding
    cuts = cut_places(parts, pattern, overlap)

    def encode_alone():
        enc = encoding(path, pattern)

        def step(cols):
            *kept, at, texts, own, until = cols
            return [*kept, [narrow(enc, encode_piece(enc, t[a - x : None if b is None else b - x])) for x, t, a, b in zip(at, texts, own, until)]]

        return step

    def encode_joined():
        enc = encoding(path, pattern)

        def step(cols):
            ids = []
            for chunks, own, until in zip(cols[4], cols[5], cols[6]):
                base, joined = chunks[0]["at"], [chunks[0]["text"]]
                reached = base + len(joined[0])
                for c in chunks[1:]:
                    joined.append(c["text"][reached - c["at"] :])
                    reached = c["at"] + len(c["text"])
                ids.append(narrow(enc, encode_piece(enc, "".join(joined)[own - base : None if until is None else until - base])))
            return [*cols[:4], ids]

        return step

    # both join on the keys that the chunks are dealt out by: their texts stay in place
    alone = parts.join(cuts.where("alone"), ["key", "chunk"]).select("key", "doc_id", "copies", "piece", "at", "text", "own", "until")
    together = (
        parts.join(cuts.where("not alone"), ["key", "chunk"])
        .groupBy("key", "piece")
        .agg(F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("chunks"), F.max("own").alias("own"), F.max("until").alias("until"))
        .select("key", "doc_id", "copies", "piece", "chunks", "own", "until")
    )
    done = map_rows(alone, PIECES, encode_alone).unionByName(map_rows(together, PIECES, encode_joined))
    joined = done.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    repeated = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("doc_id", F.transform("parts", lambda x: x["ids"]).alias("parts"))


def encode_short(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of texts of one chunk."""

    def make():
        enc = encoding(path, pattern)
        return lambda cols: [cols[0], [encode_piece(enc, t) for t in cols[1]]]

    return map_rows(docs, ENCODED, make)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit integers) of every text.

    ``path`` names the rank file on every machine. Special tokens are not recognised.
    Null and empty texts have no ids; repeated rows are repeated; a null id stays null;
    other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    is_long = F.length("text") > chunk
    long = encode_long(texts.where(is_long), path, pattern, chunk, overlap)

    def join():
        enc = encoding(path, pattern)
        return lambda cols: [cols[0], [b"".join(wide(enc, x) for x in p) for p in cols[1]]]

    whole = map_rows(long, ENCODED, join)
    return encode_short(texts.where(~is_long), path, pattern).unionByName(whole)


DIGESTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_pieces", T.LongType())]
)


def digest(enc: tiktoken.Encoding, parts: list[bytes]) -> tuple[int, str, str, int]:
    """Tokens, the digests of the ids and of the bytes that they decode to, and pieces."""
    ids, text = hashlib.sha256(), hashlib.sha256()
    for part in parts:
        ids.update(part)
        text.update(decode(enc, part))
    return sum(map(len, parts)) // 4, ids.hexdigest(), text.hexdigest(), len(parts)


def digests(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digests of encoded texts (doc_id, parts)."""

    def make():
        enc = encoding(path, pattern)

        def step(cols):
            found = [digest(enc, [wide(enc, x) for x in parts]) for parts in cols[1]]
            return [cols[0], *([f[i] for f in found] for i in range(4))]

        return step

    return map_rows(encoded.select("doc_id", "parts"), DIGESTS, make)


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_pieces of every text (see
    ``encode``): the digests of its ids and of what they decode to.

    Texts of one chunk are encoded and decoded in one pass, so that a task needs one
    Python worker.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    is_long = F.length("text") > chunk

    def make():
        enc = encoding(path, pattern)

        def step(cols):
            found = [digest(enc, [encode_piece(enc, t)]) for t in cols[1]]
            return [cols[0], *([f[i] for f in found] for i in range(4))]

        return step

    long = encode_long(texts.where(is_long), path, pattern, chunk, overlap)
    return map_rows(texts.where(~is_long), DIGESTS, make).unionByName(digests(long, path, pattern))
