"""Token ids as fixed-width packed blocks, and reading them back.

A packed table is a folder of Parquet files. Every row is one block:

    shard     long           number of the range of doc_ids it belongs to
    block     long           number of the block in its shard, from 0
    first     long           ids of the shard before this block
    bits      int            bits of each id: as many as the vocabulary needs
    room      int            ids that a block holds
    n_ids     int            ids in the block
    numbers   array<long>    for each piece of a document in it: the document's number
    doc_ids   array<long>    ... its doc_id
    lengths   array<long>    ... the ids it has in this block
    payload   binary         the ids, id i in bits [i * bits, (i + 1) * bits) counted
                             from the lowest bit of the first byte

Blocks are full but for the last of a shard, so the block with the id at position p of
a shard is p // room, and a fixed width makes any id of it readable
without those before it. Spark's own writer commits the files, so a lost executor or a
repeated task leaves no half-written block behind.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.common import scratch_folder, text_or_empty, to_arrow
from certloom.llm.word_bpe import remembered_ids, words_of

BLOCK_IDS = 65_536


def width(n_vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (n_vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """Ids [start, start + n) of a block, without touching the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}", count=n, offset=start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-(start + n) * bits // 8)
    planes = np.unpackbits(np.frombuffer(payload[first:last], dtype=np.uint8), bitorder="little")
    skip = start * bits - first * 8
    planes = planes[skip : skip + n * bits].reshape(n, bits).astype(np.uint32)
    return (planes << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


BLOCKS = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("room", T.IntegerType()),
        T.StructField("n_ids", T.IntegerType()),
        T.StructField("numbers", T.ArrayType(T.LongType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


class Blocks:
    """Gathers documents of one shard into blocks of ``room`` ids."""

    def __init__(self, shard: int, bits: int, room: int):
        self.shard, self.bits, self.room, self.block, self.number = shard, bits, room, 0, 0
        self.parts: list[np.ndarray] = []
        self.pieces: list[tuple] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray):
        """Rows of the blocks that this document completes."""
        at = 0
        while True:
            take = min(len(ids) - at, self.room - self.size)
            self.parts.append(ids[at : at + take])
            self.pieces.append((self.number, doc_id, take))
            self.size += take
            at += take
            if self.size == self.room:
                yield self.close()
            if at == len(ids):
                break
        self.number += 1

    def close(self) -> tuple:
        numbers, doc_ids, lengths = (list(x) for x in zip(*self.pieces))
        row = (self.shard, self.block, self.block * self.room, self.bits, self.room, self.size, numbers, doc_ids, lengths, pack(np.concatenate(self.parts), self.bits))
        self.parts, self.pieces, self.size = [], [], 0
        self.block += 1
        return row


def write_packed(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, room: int = BLOCK_IDS) -> None:
    """Encode every text with the tokenizer file at ``path``, append ``end_id``, and
    write the ids in ascending order of the id column as a packed table to ``folder``.

    Documents are dealt out to ``shards`` ranges of ids (as many as Spark shuffles into,
    by default); a shard's blocks are made in one task, one after the other. Null texts
    count as empty, null ids come first, repeated ids follow each other in the order of
    a hash of their texts. An empty table gives a table without blocks.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = to_arrow(BLOCKS)
    end = array("I", [end_id]).tobytes()

    def run(batches):
        from pyspark import TaskContext

        words, ids = words_of(path), remembered_ids(path)
        bits = width(words.library.get_vocab_size(with_added_tokens=True))
        blocks = Blocks(TaskContext.get().partitionId(), bits, room)
        rows = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = words.pieces(text)
                if pieces is None:
                    found = array("I", words.library.encode(text, add_special_tokens=False).ids).tobytes()
                else:
                    found = b"".join(map(ids.__getitem__, pieces))
                rows.extend(blocks.add(doc_id, np.frombuffer(found + end, dtype=np.uint32)))
                if len(rows) >= 16:
                    yield as_batch(rows, schema)
                    rows = []
        if blocks.pieces:
            rows.append(blocks.close())
        if rows:
            yield as_batch(rows, schema)

    text = text_or_empty(text_col)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ordered.mapInArrow(run, BLOCKS).write.mode("overwrite").parquet(folder)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


PIECES = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("number", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("crc", T.LongType()),
    ]
)
JOINED = T.StructType([T.StructField("shard", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

#: The polynomial of zlib's CRC-32, lowest power at the highest bit.
POLYNOMIAL = 0xEDB88320


def _times(matrix: list[int], bits: int) -> int:
    """A vector of 32 bits by a matrix of 32 columns, over the field of two."""
    total, i = 0, 0
    while bits:
        if bits & 1:
            total ^= matrix[i]
        bits >>= 1
        i += 1
    return total


def crc_joined(first: int, second: int, n_second: int) -> int:
    """The CRC-32 of two byte strings end to end, from theirs and the second's length.

    Appending a zero bit is linear in the CRC, so that appending many is a power of one
    matrix, taken by squaring.
    """
    matrix, n = [POLYNOMIAL, *(1 << i for i in range(31))], n_second * 8
    while n:
        if n & 1:
            first = _times(matrix, first)
        matrix = [_times(matrix, column) for column in matrix]
        n >>= 1
    return first ^ second


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in parts with the CRC of the whole, from those of the parts."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            crc = 0
            for part in row["parts"]:
                crc = crc_joined(crc, part["crc"], 4 * part["n"])
            rows.append((row["shard"], row["doc_id"], row["at"], row["n_tokens"], crc))
        if rows:
            yield as_batch(rows, to_arrow(JOINED))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a packed table; of an
    empty table none.

    ``start`` counts the ids of all documents before it over all shards. A document
    in one block is done where its block is read; only the parts of those that cross
    blocks (two of a block at most) are brought together.
    """
    schema = to_arrow(PIECES)

    def pieces_of(crossing: bool):
        def run(batches):
            for batch in batches:
                for block in batch.to_pylist():
                    ids = unpack(block["payload"], block["bits"], block["n_ids"]).astype("<u4")
                    rows, at = [], 0
                    last = len(block["numbers"]) - 1
                    for i, (number, doc_id, n) in enumerate(zip(block["numbers"], block["doc_ids"], block["lengths"])):
                        if crossing == (i == 0 and block["block"] > 0 or i == last and block["n_ids"] == block["room"]):
                            data = ids[at : at + n].tobytes()
                            rows.append((block["shard"], number, block["block"], doc_id, block["first"] + at, n, zlib.crc32(data)))
                        at += n
                    if rows:
                        yield as_batch(rows, schema)

        return run

    stored = spark.read.parquet(folder)
    # one number for each shard, and there are as many shards as partitions
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    base, before = [], 0
    for row in sorted(totals):
        base.append((row["shard"], before))
        before += row["n"]
    bases = spark.createDataFrame(base, "shard long, base long")
    whole = stored.mapInArrow(pieces_of(crossing=False), PIECES).select("shard", "doc_id", "at", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    joined = (
        stored.mapInArrow(pieces_of(crossing=True), PIECES)
        .groupBy("shard", "number")
        .agg(F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("parts"))
        .select("shard", "doc_id", "at", "n_tokens", "parts")
    )
    joined = joined.mapInArrow(combined, JOINED)
    return (
        whole.unionByName(joined)
        .join(F.broadcast(bases), "shard")
        .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )


def read_ids(spark: SparkSession, folder: str, shard: int, position: int, n: int) -> np.ndarray:
    """Ids [position, position + n) of a shard, from the blocks that hold them alone; a
    span that ends beyond the shard is cut there."""
    stored = spark.read.parquet(folder).where(F.col("shard") == shard)
    inside = (F.col("first") < position + n) & (F.col("first") + F.col("n_ids") > position)
    out = []
    for block in stored.where(inside).select("first", "bits", "n_ids", "payload").orderBy("first").toLocalIterator():
        start = max(0, position - block["first"])
        out.append(unpack(block["payload"], block["bits"], min(block["n_ids"], position + n - block["first"]) - start, start))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def fresh_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/packed-{uuid.uuid4().hex}"
