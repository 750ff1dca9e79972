"""Fill-in-middle documents: prefix, middle and suffix of a text in another order.

A text is cut between units, runs of the letters A-Z or one other code point. One numpy
kernel works on the UTF-8 buffer of a whole Arrow batch: a lookup of byte classes, a mask
of the bytes at which a unit begins (from neighbouring bytes), cumulative sums that begin
anew with each document, and a searchsorted that finds the cuts of all rows together.
Outputs are gathered from the same buffer. Nothing is shuffled, and memory is bounded by
the bytes of a batch (or of its longest text).

Where to cut and in which form follows from a SHA-256 of the document's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.llm.common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = (PREFIX + SUFFIX + MIDDLE).encode()
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
#: Byte classes: continuation of a code point, letter, any other first byte.
CONTINUED, LETTER, OTHER = 0, 1, 2
CLASSES = np.full(256, OTHER, dtype=np.uint8)
CLASSES[0x80:0xC0] = CONTINUED
CLASSES[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER

_SCHEMA = "_id string, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("_id", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a column of strings without nulls: row i is bytes[bounds[i]:bounds[i + 1]]."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return every[bounds[0] : bounds[-1]], bounds - bounds[0]


def running(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and in all."""
    out = np.zeros(len(mask) + 1, dtype=np.int32 if len(mask) < 2**31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the bytes at which a unit begins and of those at which a code point does."""
    kind = CLASSES[data]
    after_letter = np.zeros(len(data), dtype=bool)
    after_letter[1:] = kind[:-1] == LETTER
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    after_letter[firsts] = False  # another document's letter
    return (kind == OTHER) | ((kind == LETTER) & ~after_letter), kind != CONTINUED


def marked(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows that contain one of the marks themselves."""
    found = np.zeros(len(bounds) - 1, dtype=bool)
    if len(data) > 2:
        names = np.zeros(256, dtype=bool)
        names[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = True
        at = np.flatnonzero((data[:-2] == ord("<")) & names[data[1:-1]] & (data[2:] == ord(">")))
        row = np.searchsorted(bounds, at, side="right") - 1
        found[row[at + 3 <= bounds[row + 1]]] = True
    return found


def rearrange(data: np.ndarray, bounds: np.ndarray, h: np.ndarray, plain_from: int, spm_below: int) -> tuple[np.ndarray, ...]:
    """(n, form, prefix_chars, middle_chars, output, output bounds) of all rows of a buffer.

    ``h``: four hash values of each row: two cuts, whether plain, which order.
    """
    starts, points = unit_starts(data, bounds)
    units, chars = running(starts), running(points)
    begin, end = bounds[:-1], bounds[1:]
    before = units[begin].astype(np.int64)
    n = units[end] - before
    form = np.where((n == 0) | marked(data, bounds) | (h[2] % 100 >= plain_from), PLAIN, np.where(h[3] % 100 < spm_below, SPM, PSM))
    one, two = h[0] % (n + 1), h[1] % (n + 1)

    def cut(k: np.ndarray) -> np.ndarray:
        """The byte at which unit k of each row begins, or at which the row ends."""
        return np.minimum(np.searchsorted(units, before + k + 1, side="left") - 1, end)

    first, second = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    first, second = np.maximum(first, begin), np.maximum(second, begin)

    # six pieces a row, each from the texts or from the marks behind them
    source = np.concatenate([data, np.frombuffer(_MARKS, dtype=np.uint8)])
    mark = {m: np.full(len(n), len(data) + 3 * i) for i, m in enumerate((PREFIX, SUFFIX, MIDDLE))}
    pieces = {
        PLAIN: [(begin, end), *[(begin, begin)] * 5],
        PSM: [(mark[PREFIX], mark[PREFIX] + 3), (begin, first), (mark[SUFFIX], mark[SUFFIX] + 3), (second, end), (mark[MIDDLE], mark[MIDDLE] + 3), (first, second)],
        SPM: [(mark[SUFFIX], mark[SUFFIX] + 3), (second, end), (mark[PREFIX], mark[PREFIX] + 3), (begin, first), (mark[MIDDLE], mark[MIDDLE] + 3), (first, second)],
    }
    at = np.stack([np.choose(form, [pieces[f][i][0] for f in (PLAIN, PSM, SPM)]) for i in range(6)], axis=1)
    to = np.stack([np.choose(form, [pieces[f][i][1] for f in (PLAIN, PSM, SPM)]) for i in range(6)], axis=1)
    size = (to - at).ravel()
    ends = np.cumsum(size)
    index = np.repeat(at.ravel() - (ends - size), size)
    index += np.arange(len(index))
    out_bounds = np.concatenate([[0], ends[5::6]])
    return n, form, chars[first] - chars[begin], chars[second] - chars[first], source[index], out_bounds


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1:", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    The first four groups of eight hex digits of sha256(``salt`` || id) are h1 to h4: the
    prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle
    after the larger. Form "plain" leaves the text: empty ones, those that contain a
    mark, and those with h3 % 100 >= ``plain_from``; of the others those with
    h4 % 100 < ``spm_below`` are "spm", the rest "psm". A null text counts as empty, and
    a null id as an empty string; rows that repeat an id are cut by the same hash, each
    in its own text. Code points are counted (null for plain). Other columns are
    ignored, and an empty table gives no rows.
    """
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), text_or_empty(text_col).alias("_text"), *[x.alias(f"_h{i}") for i, x in enumerate(h)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = utf8_buffer(batch.column(1))
            h = np.stack([batch.column(i).to_numpy() for i in range(2, 6)])
            n, form, prefix, middle, output, out_bounds = rearrange(data, bounds, h, plain_from, spm_below)
            plain = form == PLAIN
            texts = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(out_bounds.astype(np.int64)), pa.py_buffer(output)).cast(pa.string())
            counts = [pa.array(x.astype(np.int64), mask=plain) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(n), pa.array(np.array(FORMS, dtype=object)[form]), *counts, texts], schema=_ARROW)
        # workers outlive their tasks: what Arrow keeps for later goes back
        pa.default_memory_pool().release_unused()

    out = rows.mapInArrow(run, _SCHEMA)
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The exact text from which an output in a form was made.

    Texts that hold a mark are plain, so that each mark is found once in the others.
    """
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, PREFIX, -1), SUFFIX, 1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(F.substring_index(head, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
