"""Token counts and ids by a word-level BPE file, with a whole-token shortcut.

Most words of a corpus are, or repeat, a small set of strings. Which vocabulary strings
encode alone as exactly one token is proved once, by encoding each of them; a
pre-token from that set counts as one without merging. The rest is merged by the
library, once for each distinct pre-token that a task meets.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from certloom.llm.common import map_rows, text_or_empty

#: Distinct merged pre-tokens that a worker remembers; beyond them it merges each again.
REMEMBERED = 400_000

#: Last code point of the alphabets whose letters, digits, case and normal form no
#: Unicode version has changed; within them Python splits as the library does.
PLAIN_LAST = 0x17F


def _plain_classes() -> tuple[str, str, str]:
    """(plain characters, letters, numbers) up to PLAIN_LAST as character classes.

    White space that only one of the two sides counts as such, characters that change
    under NFC and letters whose lower case isn't one stable letter are left out; texts
    with them go through the library as a whole.
    """
    plain, letters, numbers = [], [], []
    for code in range(PLAIN_LAST + 1):
        c = chr(code)
        if 0x7F <= code <= 0xA0 or code < 0x20 and c not in "\t\n\r" or unicodedata.normalize("NFC", c) != c or len(c.lower()) != 1 or c in "ŉİ":
            continue
        plain.append(c)
        kind = unicodedata.category(c)[0]
        if kind == "L":
            letters.append(c)
        elif kind == "N":
            numbers.append(c)
    return tuple("".join(map(re.escape, x)) for x in (plain, letters, numbers))


class Words:
    """Pre-tokens of plain texts and their ids, equal to what the library gives."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model
        self.bytes = byte_characters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.added = re.compile("|".join(added) or "(?!)")
        plain, letters, numbers = _plain_classes()
        self.plain = re.compile(f"[{plain}]*+")
        # The file's pattern with its alternatives in another order: they start with
        # different characters, so that the order does not matter.
        self.split = re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{letters}{numbers}]+").findall

    def pieces(self, text: str) -> list[str] | None:
        """Pre-tokens of a text, or None if it is to go through the library."""
        if self.plain.fullmatch(text) is None or self.added.search(text):
            return None
        return self.split(text.lower())

    def ids(self, piece: str) -> list[int]:
        """Ids of one pre-token of a plain text, by the merges alone."""
        if not piece.isascii():
            piece = "".join(map(self.bytes.__getitem__, piece.encode()))
        return [t.id for t in self.merges.tokenize(piece)]


class Remembered(dict):
    """What ``make`` gives for each key; REMEMBERED of them are kept beside the fixed ones."""

    def __init__(self, make, fixed: Iterable[tuple] = ()):
        super().__init__(fixed)
        self.make, self.room = make, len(self) + REMEMBERED

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.room:
            self[key] = value
        return value


@cache
def words_of(path: str) -> Words:
    """The tokenizer of a worker process; its later tasks find it loaded."""
    return Words(path)


@cache
def remembered_counts(path: str) -> Remembered:
    words = words_of(path)
    return Remembered(lambda piece: len(words.ids(piece)))


@cache
def remembered_ids(path: str) -> Remembered:
    """The ids of pre-tokens as little-endian 32-bit integers."""
    words = words_of(path)
    return Remembered(lambda piece: array("I", words.ids(piece)).tobytes())


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that alone encode as exactly that one token.

    Proved by encoding every string that ends a word; nothing is assumed from the
    order of merges. The list is bounded by the vocabulary of the file.
    """
    words = words_of(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    back = {v: k for k, v in byte_characters().items()}
    proven = []
    for token, token_id in model["vocab"].items():
        if not token.endswith(end) or len(token) == len(end):
            continue
        try:
            text = bytes(back[c] for c in token[: len(token) - len(end)]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if words.pieces(text) == [text] and words.ids(text) == [token_id]:
            proven.append(text)
    return proven


def byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1
    bytes as themselves, the others counted up from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


COUNT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
        T.StructField("n_whole", T.LongType()),
    ]
)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text by the tokenizer file at ``path`` (on every machine).

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)
    and n_whole (pre-tokens that the shortcut counted). Null and empty texts have 0.
    Repeated rows are repeated, a null id stays null, other columns are ignored.
    """
    proven = docs.sparkSession.sparkContext.broadcast(frozenset(whole_tokens(path)))

    def make():
        words, counts, whole = words_of(path), remembered_counts(path), proven.value
        counts.update(dict.fromkeys(whole, 1))

        def step(cols):
            out = [[] for _ in COUNT_SCHEMA]
            for doc_id, text, n_bytes in zip(*cols):
                pieces = words.pieces(text)
                if pieces is None:
                    n, shortcut = len(words.library.encode(text, add_special_tokens=False).ids), 0
                else:
                    n = sum(map(counts.__getitem__, pieces))
                    shortcut = sum(map(whole.__contains__, pieces))
                for col, value in zip(out, (doc_id, n_bytes, n, n > limit, shortcut)):
                    col.append(value)
            return out

        return step

    text = text_or_empty(text_col)
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")), COUNT_SCHEMA, make)
