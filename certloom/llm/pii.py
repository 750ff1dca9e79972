"""Personal data in texts, also behind disguises, with spans in source characters.

Plain identifiers are found by patterns on the source text. A second look goes through
a chain of small transducers that undo disguises (homoglyphs and invisible characters,
at/dot spellings, spelled digits). Every transducer keeps, for each character that it
writes, the source range it stands for, so what is detected in the rewritten text maps
back to source characters. Plain spans always stay; a disguised one is added only if
its source range was rewritten.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.common import map_rows, text_or_empty

KINDS = ("email", "ip", "card", "phone")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Possessive digit runs and the look-behind find the same matches as the plain
# patterns (a run of digits can only be entered at its start) in linear time.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of EMAIL, looked for around each @ only."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            found.append(m.span())
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def ips(text: str) -> list[tuple[int, int]]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) < 3 or (len(part) == 3 and part <= "255")

    if not DOTTED_DIGITS.search(text):
        return []
    return [m.span() for m in IP.finditer(text) if all(map(small, m.groups()))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of plain identifiers, by kind and then start."""
    found = [(0, *s) for s in emails(text)] if "@" in text else []
    found += [(1, *s) for s in ips(text)]
    found += [(2, *s) for s in cards(text)]
    found += [(3, *s) for s in phones(text)] if "+" in text else []
    return found


# ---- transducers -----------------------------------------------------------------


@dataclass
class View:
    """A rewritten text; character i stands for source[starts[i]:ends[i]]."""

    text: str
    starts: list[int]
    ends: list[int]

    @classmethod
    def of(cls, text: str) -> View:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def replaced(self, changes: list[tuple[int, int, str]]) -> View:
        """With each (start, end, new) put in; they are in order and don't overlap."""
        text, starts, ends, last = [], [], [], 0
        for a, b, new in changes:
            text += [self.text[last:a], new]
            starts += self.starts[last:a] + [self.starts[a]] * len(new)
            ends += self.ends[last:a] + [self.ends[b - 1]] * len(new)
            last = b
        if not last:
            return self
        return View("".join([*text, self.text[last:]]), starts + self.starts[last:], ends + self.ends[last:])

    def translated(self, table: dict[str, str]) -> View:
        """Each character by what stands for it in ``table``: one character, or none."""
        new = [table.get(c, c) for c in self.text]
        kept = [i for i, c in enumerate(new) if c]
        return View("".join(new), [self.starts[i] for i in kept], [self.ends[i] for i in kept])


# Letters of other scripts that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ʟ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "․": ".", "⁺": "+",
}
INVISIBLE = "­​‌‍‎‏⁠﻿"


@cache
def characters() -> tuple[dict[str, str], frozenset[str]]:
    """What each disguised character stands for, and the set of them: any of them calls
    for a second look. Compatibility forms (full-width,
    mathematical, circled, superscript) come from Unicode's own decompositions."""
    table = {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        digit = unicodedata.digit(c, None)
        if len(plain) == 1 and plain.isascii() and (plain.isalnum() or plain in "@.+-()%_"):
            table[c] = plain
        elif digit is not None:
            table[c] = str(digit)
    table |= LOOKALIKES
    table |= dict.fromkeys(INVISIBLE, "")
    for c in "ªº":  # ordinary signs of Romance languages
        table.pop(c, None)
    return table, frozenset(table)


# The digits in English, Spanish, French and German.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
# Endings that make an address of "name at host.ending".
ENDINGS = frozenset("com org net edu gov mil int info biz name dev app example test io ai co me tv eu de fr es it nl uk us ca ch at be pl ru cn jp in br au".split())
#: "Look at the dot in it": after these a dot is a thing, unless a known ending of three
#: letters or more follows.
DETERMINERS = frozenset("the a an this that each every any some my your his her its our their".split())

# Every pattern takes time in proportion to the text: runs are possessive, and each
# starts at a sign or a word that no other start shares.
_D = r"(?:(?:double|triple)[\s-]++)?+(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPACED_DOT = r"\s++(?:dot|punkt|punto)\s++"
_BRACKETS = r"[\(\[\{<]\s*+(?:%s)\s*+[\)\]\}>]"
_GAP = r"[\s,-]++"
#: A run of spelled digits, with separators and spelled dots between them.
SPELLED = re.compile(rf"(?:\b(?:plus|más){_GAP})?+\b{_D}\b(?:(?:{_SPACED_DOT}|\s*+{_BRACKETS % '(?:dot|punkt|punto|[.])'}\s*+|{_GAP}){_D}\b)*+", re.I)
SPELLED_PART = re.compile(rf"(?P<plus>\b(?:plus|más){_GAP})|(?P<digit>\b{_D}\b)|(?P<dot>\s*+(?:dot|punkt|punto|{_BRACKETS % '(?:dot|punkt|punto|[.])'})\s*+)|(?P<gap>{_GAP})", re.I)
BRACKETED = re.compile(_BRACKETS % r"(?P<at>at|arroba|arobase|@)|dot|punkt|punto|point|[.]", re.I)
NUMBER_DOT = re.compile(rf"(?<=[0-9]){_SPACED_DOT}(?=[0-9])", re.I)
#: The sign of an address in words, and the labels of its host.
AT = re.compile(r"@|(?<=\s)(?:at|arroba|arobase)(?=\s)", re.I)
_HOST = r"[A-Za-z0-9-]++"
HOST = re.compile(_HOST)
NEXT_LABEL = re.compile(rf"(?P<dot>\.|\s++(?:dot|punkt|punto|(?P<point>point))\s++)(?P<label>{_HOST})", re.I)
AFTER_SPACED_AT = re.compile(rf"{_HOST}(?:\s*+\.\s*+|\s++dot\s++)[A-Za-z]", re.I)
NAME_DOT = re.compile(r"\s+dot$", re.I)
#: Signs of addresses as they are written in links and in markup.
ESCAPED = re.compile(r"(?P<at>%40(?=[a-z0-9])|&#0*+64;|&#x0*+40;|&commat;)|&#0*+46;|&#x0*+2e;|&period;", re.I)
#: nameAThostDOTending and name_at_host_dot_ending.
CAPITALS = re.compile(r"(?<=[a-z0-9])AT[a-z0-9-]++(?:DOT[a-z0-9-]++)++")
JOINED = re.compile(r"(?<=[A-Za-z0-9])([_-])at\1[A-Za-z0-9]++(?:\1dot\1[A-Za-z0-9]++)++(?![A-Za-z0-9_-])", re.I)
#: Digits, with letters like them among them, and what stands between groups of digits.
NUMBER = re.compile(r"(?<![A-Za-z0-9|])(?:\+[ (]?)?[0-9OoIl|]++(?:[ .()-]{1,2}+[0-9OoIl|]++)*+")
LETTER_DIGITS = str.maketrans("OoIl|", "00111")
LETTER_IN_NUMBER = re.compile(r"[0-9+](?:\.?[OoIl|]|(?<=[OoIl|][0-9])|(?<=[OoIl|]\.[0-9]))")
DIGIT_GROUP = re.compile(r"[0-9OoIl|]+")
#: An ending that no list knows and that has more letters is a word, "at noon dot everyone
#: left", unless the name or a further label of the host says otherwise.
PLAUSIBLE_ENDING = 6
#: What calls for the address transducers, in lower-cased text.
SIGN_WORDS = re.compile(r"\s(?:dot|punkt|punto|point|arroba|arobase)\s")
LOOSE_SIGN = re.compile(r"\s@|@\s")
AT_HOST = re.compile(r"at\s++[a-z0-9-]++\.[a-z0-9-]")
DOTTED_DIGITS = re.compile(r"[0-9]\.[0-9]")


def _calls_for_address(lower: str) -> bool:
    if any(w in lower for w in ("dot", "punkt", "punto", "point", "arroba", "arobase")) and SIGN_WORDS.search(lower):
        return True
    if "@" in lower and LOOSE_SIGN.search(lower):
        return True
    return bool(BRACKETED.search(lower) or AT_HOST.search(lower))


def _lower(text: str) -> str:
    """Lower case of what a pattern took for ASCII letters, a dotted capital I among them."""
    return text.lower().replace("i\u0307", "i")


def spelled_digits(view: View) -> View:
    """Digits in words as digits, each on its own range: where three or more follow each
    other, and where dots between them make an address of four numbers."""
    changes = []

    def written_out(word: str) -> str:
        words = re.split(r"[\s-]+", _lower(word))
        return DIGIT_WORDS[words[-1]] * {"double": 2, "triple": 3}.get(words[0], 1)

    for run in SPELLED.finditer(view.text):
        parts = list(SPELLED_PART.finditer(view.text, *run.span()))
        groups = [[]]
        for m in parts:
            groups[-1].append(m)
            if m.lastgroup == "dot":
                groups.append([])
        as_address = len(groups) >= 4
        for group in groups:
            digits = sum(len(written_out(m[0])) for m in group if m.lastgroup == "digit")
            if not as_address and digits < 3:
                continue
            for m in group:
                new = written_out(m[0]) if m.lastgroup == "digit" else "+" if m.lastgroup == "plus" else "." if m.lastgroup == "dot" else ""
                if m.lastgroup != "dot" or as_address:
                    changes.append((m.start(), m.end(), new))
    return view.replaced(changes)


def letters_as_digits(view: View) -> View:
    """O, I, l and | as digits in numbers of seven signs or more, most of them digits.

    They are so in groups that have a digit, that follow a dot or a plus sign, or that have
    three signs; any other group may be a word or a line of a table.
    """
    changes, text = [], view.text
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if b < len(text) and (text[b].isalnum() or text[b] == "_"):  # its last group is the beginning of a word
            while b > a and text[b - 1] in "0123456789OoIl|":
                b -= 1
        found, digits = [], 0
        for g in DIGIT_GROUP.finditer(text, a, b):
            n = sum(c in "0123456789" for c in g[0])
            digits += n
            if n < len(g[0]) and (n or len(g[0]) > 2 or text[g.start() - 1 : g.start()] in (".", "+")):
                found += [(i, i + 1, c.translate(LETTER_DIGITS)) for i, c in enumerate(g[0], g.start()) if c in "OoIl|"]
        if len(found) + digits >= 7 and digits >= 2 * len(found) or digits >= len(found) and text.count(".", a, b) == 3:
            changes += found
    return view.replaced(changes)


def escaped_signs(view: View) -> View:
    """%40, &#64;, &#46; and the like as the signs."""
    return view.replaced([(*m.span(), "@" if m["at"] else ".") for m in ESCAPED.finditer(view.text)])


def joined_words(view: View) -> View:
    """nameAThostDOTending, and with a known ending name_at_host_dot_ending."""
    text, changes = view.text, []
    found = [(m, "AT", "DOT") for m in CAPITALS.finditer(text)]
    found += [(m, m[1] + "at" + m[1], m[1] + "dot" + m[1]) for m in JOINED.finditer(text)]
    for m, sign, dot in sorted(found, key=lambda f: f[0].start()):
        host = m[0][len(sign) :]
        labels = re.split(dot, host, flags=0 if sign == "AT" else re.I)
        ending = labels[-1]
        if changes and changes[-1][1] > m.start() or not re.fullmatch("[A-Za-z]{2,24}", ending) or not all(labels):
            continue
        if sign != "AT" and labels[0].lower() in DETERMINERS or ending.lower() not in ENDINGS and (sign != "AT" or len(ending) > PLAUSIBLE_ENDING):
            continue
        changes.append((m.start(), m.start() + len(sign), "@"))
        at = m.start() + len(sign)
        for label in labels[:-1]:
            at += len(label)
            changes.append((at, at + len(dot), "."))
            at += len(dot)
    return view.replaced(changes)


def bracketed_signs(view: View) -> View:
    """(at), [dot] and the like, with the blanks around them, as the signs."""
    text, changes, free = view.text, [], 0
    for m in BRACKETED.finditer(text):
        a, b = m.span()
        while a > free and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        changes.append((a, b, "@" if m["at"] else "."))
        free = b
    return view.replaced(changes)


def spaced_signs(view: View) -> View:
    """An @ with blanks beside it, between a name and a host, without them."""
    text, changes, free = view.text, [], 0
    at = text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > free and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        if b - a > 1 and a > 0 and text[a - 1] in LOCAL and AFTER_SPACED_AT.match(text, b):
            changes.append((a, b, "@"))
        free = b
        at = text.find("@", b)
    return view.replaced(changes)


def _name_start(text: str, end: int, free: int) -> tuple[int, list[tuple[int, int]]]:
    """Where a name that ends at ``end`` begins, and its spelled dots."""
    start, dots = end, []
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    while start < end:
        a = start
        while a > free and text[a - 1].isspace():
            a -= 1
        b = a - 3
        if a == start or b < free or text[b:a].lower() != "dot":
            break
        c = b
        while c > free and text[c - 1].isspace():
            c -= 1
        d = c
        while d > free and text[d - 1] in LOCAL:
            d -= 1
        if c == b or d == c:
            break
        dots.append((c, start))
        start = d
    return start, dots[::-1]


def addresses_in_words(view: View) -> View:
    """name at host dot ending, looked for around each sign.

    The sign in words needs a last dot in words, too; with a known ending a dot in words
    anywhere will do, or a name that can't be a plain word. After an @ all dots of the
    host are in words, or some and the ending is known.
    """
    text, changes, free, at = view.text, [], 0, 0
    while (sign := AT.search(text, at)) is not None:
        at = sign.end()
        plain, right = sign[0] == "@", sign.end()
        while not plain and right < len(text) and text[right].isspace():
            right += 1
        host = HOST.match(text, right)
        if host is None:
            continue
        labels, end = [(None, host)], host.end()
        while (m := NEXT_LABEL.match(text, end)) is not None and (m["point"] is None or sign[0].lower() == "arobase"):
            labels.append((m["dot"], m))
            end = m.end()
        while len(labels) > 1 and not re.fullmatch("[A-Za-z]{2,24}", labels[-1][1]["label"]):
            labels.pop()
        if len(labels) == 1:
            continue
        end = labels[-1][1].end()
        left = sign.start()
        while not plain and left > free and text[left - 1].isspace():
            left -= 1
        start, dots = _name_start(text, left, free)
        if start == left:
            continue
        spelled = [dot != "." for dot, _ in labels[1:]]
        ending = labels[-1][1]["label"].lower()
        known = ending in ENDINGS
        any_spelled = any(spelled) or bool(dots)
        out = all(spelled) if plain else spelled[-1]
        if host[0].lower() in DETERMINERS and not (known and len(ending) > 2):
            continue
        odd_name = not plain and re.search("[._0-9]", text[start:left]) is not None
        if not (out or known and (any_spelled or odd_name)):
            continue
        if sign[0].lower() == "at" and len(ending) > PLAUSIBLE_ENDING and not (known or odd_name or dots or len(labels) > 2):
            continue
        changes += [(a, b, ".") for a, b in dots]
        if not plain:
            changes.append((left, right, "@"))
        changes += [(m.start("dot"), m.end("dot"), ".") for dot, m in labels[1:] if dot != "."]
        free = at = end
    return view.replaced(changes)


def undisguised(text: str) -> View | None:
    """The text after all transducers, or None if nothing in it calls for them."""
    table, disguised = characters()
    odd = not text.isascii() and not disguised.isdisjoint(text)
    # each is a necessary condition; the dots of a spelled IP call for an address, too
    lower = text.lower()
    escaped = any(x in lower for x in ("%40", "&#", "&commat;", "&period;"))
    joined = "dot" in lower and ("AT" in text and "DOT" in text or "_at_" in lower or "-at-" in lower)
    if not (odd or escaped or joined or LETTER_IN_NUMBER.search(text) or _calls_for_address(lower) or any(m.end() - m.start() > 8 for m in SPELLED.finditer(text))):
        return None
    view = View.of(text)
    if odd:
        view = view.translated(table)
    if escaped:
        view = escaped_signs(view)
    view = spelled_digits(letters_as_digits(view))
    view = view.replaced([(*m.span(), ".") for m in NUMBER_DOT.finditer(view.text)])
    if "dot" in view.text.lower():
        view = joined_words(view)
    return addresses_in_words(spaced_signs(bracketed_signs(view)))


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and all spans (plain and disguised), each by kind and start."""
    base = detect(text)
    view = undisguised(text)
    if view is None:
        return base, base
    known = set(base)
    taken = sorted((a, b) for _, a, b in base)
    extra = set()
    for kind, a, b in detect(view.text):
        span = (kind, view.starts[a], view.ends[b - 1])
        if span in known or text[span[1] : span[2]] == view.text[a:b]:
            continue
        # inside a plain span of another kind there is nothing new
        i = bisect_left(taken, (span[1] + 1, -1))
        if any(x <= span[1] and span[2] <= y for x, y in taken[max(0, i - 3) : i]):
            continue
        extra.add(span)
    return base, sorted(known | extra)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_base", T.LongType())]
)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs`` with its identifiers.

    Counts (n_email, n_ip, n_card, n_phone) and ``spans`` are of all spans, plain and
    disguised; ``base_sha256`` and ``n_base`` are of the plain ones. Plain spans always
    stay, so that an identifier of which the patterns see a part only (after an invisible
    character in a name) counts as that part and as the whole. Offsets are code points of the source text, the end exclusive. Null and empty texts have no spans,
    repeated rows are repeated, a null id stays null, other columns are ignored.
    """

    def make():
        def step(cols):
            ids, texts = cols
            out = [[] for _ in SCHEMA]
            for doc_id, text in zip(ids, texts):
                base, spans = find(text)
                counts = [0] * len(KINDS)
                for k, _, _ in spans:
                    counts[k] += 1
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                for col, value in zip(out, (doc_id, *counts, digest, written(spans), len(base))):
                    col.append(value)
            return out

        return step

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), SCHEMA, make)


assert sys.version_info >= (3, 11), "possessive quantifiers are used"
