"""Toxicity by a lexicon, its misspellings and the words around each hit.

The lexicon is a short list of insults and the terms and stems that labelled toxic texts
have and clean ones lack, counted by Spark over a bounded sample of labelled rows. A term
with a clean word next to it is matched without misspellings. Words are matched by an
automaton: the Levenshtein automata of all terms intersected with the terms' trie, made
deterministic state by state as words need it. A stem is a state that accepts whatever
follows. The automaton reads a word once and leaves most words after a few characters.

Letters with blanks or dots between them and doubled letters are read as the word that they
spell. Insults that are everyday words, too, count by the share of toxic texts among the
sample's texts that have them, and not at all if no toxic one has them.

A hit counts for less inside quotation marks or next to words that mention rather than
use a term, and a document's score is a logistic function of what its hits add up to.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.common import cut, few, map_rows, text_or_empty

#: Labelled rows that are learned from, at most; all that is learned is bounded by their
#: words and by the counts that a term and a stem need.
SAMPLE = 20_000
#: A learned term is in so many toxic sample texts, after so many different words.
LEAST = 5
#: Lengths of the stems that are learned, and the words and uses that one needs.
STEMS, STEM_WORDS, STEM_USES = range(4, 8), 5, 10
#: Words up to which the promising ones are sent to every task.
BROADCAST_WORDS = 100_000
#: Words whose match a worker process remembers.
REMEMBERED = 400_000

# Insults that count without having been learned.
INSULTS = """asshole bastard bitch bullshit clown cretin cunt dickhead disgusting douchebag dumbass dumb fool fucker fucking
idiot imbecile jackass jerk loser lowlife maggot moron motherfucker pathetic pig retard retarded scum scumbag shithead
slut stupid trash vermin whore wanker worthless""".split()
# Those of them that are everyday words, too.
EVERYDAY = frozenset("clown disgusting dumb fool loser maggot pathetic pig trash vermin worthless".split())

# Words that speak about a term.
MENTIONS = frozenset("word words term terms called call calls calling said says say quote quoted quotes wrote writes slur slurs insult insults phrase meaning means definition spelled etymology dictionary".split())
#: Quotation marks, each with what closes it.
CLOSED_BY = {'"': '"', "“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’", "`": "`"}
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
FAR_EDIT, QUOTED, MENTIONED = 0.8, 0.08, 0.4

TOKEN = re.compile(r"[^\W_](?:[\w@$*!|'’-]*[\w@$])?|[@$][\w@$]+")
RUN = re.compile(r"(.)\1{2,}")
DOUBLED = re.compile(r"(.)\1+")
#: Four letters or more with one sign between any two: a word spelled out.
SPELLED_OUT = re.compile(r"(?<![^\W_])[^\W_]([ .,·~/])[^\W_](?![^\W_])(?:\1[^\W_](?![^\W_])){2,}+")
LETTERS_APART = 4
#: Signs that join words into one token, or stand in one.
JOINT = re.compile(r"[-'’_!|*]+")
MARK = re.compile(r"[\"“”„«»‹›‘’`]")


def quotations(text: str) -> list[tuple[int, int]]:
    """Disjoint ranges between quotation marks and those that close them, in order.

    Marks that open and close alike open before a word and close after one; one that
    opens again makes the one before it a stray, and one that nothing closes quotes
    nothing. Inside a word a mark is an apostrophe.
    """
    opened: dict[str, int] = {}
    found = []
    for m in MARK.finditer(text):
        c, at = m[0], m.start()
        left, right = text[at - 1 : at], text[at + 1 : at + 2]
        if c == "’" and left.isalnum() and right.isalnum():
            continue
        begins = right != "" and not right.isspace() and not left.isalnum()
        ends = left != "" and not left.isspace() and not right.isalnum()
        alike = CLOSED_BY.get(c) == c
        closing = [q for q in opened if c in CLOSED_BY[q]]
        if closing and (not alike or ends or not begins):
            found += [(opened.pop(q), at) for q in closing]
        elif c in CLOSED_BY and (not alike or begins or not ends):
            opened[c] = at
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Words within the allowed edits of a term; a transposition is one edit.

    A state is a set of (trie node, edits) and pending transpositions (node, char,
    edits); it is numbered when first met, and its moves are remembered.
    """

    ROOM = 200_000

    def __init__(self, terms: dict[str, int], stems: frozenset[str] = frozenset()):
        """``terms``: each with the edits that it allows. ``stems``: beginnings of words."""
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]  # edits that some term below the node allows
        self.ends: list[tuple[str, int] | None] = [None]
        for term, allowed in sorted(terms.items()):
            node = 0
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                    self.ends.append(None)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node] = (term, allowed)
        self.beginnings: dict[int, str] = {}
        for stem in sorted(stems):
            node = 0
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                    self.ends.append(None)
                node = self.children[node][c]
            self.beginnings[node] = stem
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, str] | None] = []
        self.begun: list[str | None] = []
        self.start = self.number(self.closed({(0, 0)}))

    def closed(self, items: set) -> frozenset:
        """With the nodes reached by leaving out characters of a term; the fewest edits
        of a node stand for the others."""
        best: dict = {}
        todo = list(items)
        while todo:
            item = todo.pop()
            key, edits = (item[0], item[-1]) if len(item) == 2 else (item[:2], item[-1])
            if best.get(key, 99) <= edits or edits > self.most[item[0]]:
                continue
            best[key] = edits
            if len(item) == 2:
                todo.extend((child, edits + 1) for child in self.children[item[0]].values())
        return frozenset((k, e) if isinstance(k, int) else (*k, e) for k, e in best.items())

    def number(self, state: frozenset) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            hits = [(s[1], self.ends[s[0]][0]) for s in state if len(s) == 2 and self.ends[s[0]] and s[1] <= self.ends[s[0]][1]]
            self.found.append(min(hits, default=None))
            self.begun.append(min((self.beginnings[s[0]] for s in state if s[-1] == 0 and len(s) == 2 and s[0] in self.beginnings), default=None))
        return n

    def move(self, state: int, c: str) -> int:
        reached = set()
        for item in self.states[state]:
            if len(item) == 3:
                node, awaited, edits = item
                if c == awaited:
                    reached.add((node, edits))
                continue
            node, edits = item
            for edge, child in self.children[node].items():
                reached.add((child, edits + (edge != c)))
                if edge != c and c in self.children[child]:
                    reached.add((self.children[child][c], edge, edits + 1))
            reached.add((node, edits + 1))
        n = self.moves[state][c] = self.number(self.closed(reached)) if reached else -1
        if not self.states[n]:
            n = self.moves[state][c] = -1
        return n

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term, (0, stem) of a stem it begins with, or None."""
        if len(self.states) > self.ROOM:
            self.reset()
        state, moves, begun = self.start, self.moves, self.begun
        for c in word:
            after = moves[state].get(c)
            if after is None:
                after = self.move(state, c)
            if after < 0:
                return None
            state = after
            if begun[state] is not None:
                return 0, begun[state]
        return self.found[state]


@dataclass(frozen=True)
class Model:
    """The lexicon with the weight of each term, and the score of what hits add up to.

    ``stems``: any word that starts with one is a hit. ``clean``: words that are none,
    whatever they resemble. ``strict``: terms matched as they are only.
    """

    terms: dict[str, float]
    stems: frozenset[str] = frozenset()
    clean: frozenset[str] = frozenset()
    strict: frozenset[str] = frozenset()
    slope: float = 4.0
    middle: float = 0.5

    def matcher(self) -> Matcher:
        return Matcher(self)

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, self.slope * (total - self.middle)))))


class Matcher:
    """Finds hits in texts; one for each worker process and model."""

    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton({t: 0 if t in model.strict else edits_allowed(t) for t in model.terms}, model.stems)
        self.longest = max(map(len, [*model.terms, *model.stems]), default=0)
        self.pieces = 4 + self.longest  # signs that a term can be drawn out by
        self.single = {x: t for t in sorted(model.terms) if t not in model.strict and len(x := DOUBLED.sub(r"\1", t)) >= LETTERS_APART}
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """What one use of a word counts, as a whole or by the words that signs join in
        it; 0 for a word that is no form of a term."""
        w = self.known.get(word)
        if w is None:
            w = self.joined(word)
            if len(self.known) < REMEMBERED:
                self.known[word] = w
        return w

    def joined(self, word: str) -> float:
        """The most that a word counts, as a whole or cut at some of the signs in it."""
        signs = [m.span() for m in JOINT.finditer(word)]
        if not signs:
            return self.look_up(word)
        starts, ends = [0, *[b for _, b in signs]], [*[a for a, _ in signs], len(word)]
        best = [0.0]
        for j, end in enumerate(ends):
            best.append(max(best[i] + self.look_up(word[starts[i] : end]) for i in range(max(0, j + 1 - self.pieces), j + 1)))
        return max(best[-1], self.look_up(word))

    def look_up(self, word: str) -> float:
        if word in self.model.clean:
            return 0.0
        hit = self.near(word)
        return 0.0 if hit is None else self.model.terms.get(hit[1], 1.0) * FAR_EDIT ** hit[0]

    def near(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term or stem, as the word is written and with
        signs for letters and long runs undone, or with no sign in it; else, as one edit,
        a term whose letters the word has once or more often, longer than the term."""
        plain = RUN.sub(r"\1", word.translate(LEET).replace("'", "").replace("’", "").replace("-", ""))
        hits = [hit for hit in map(self.automaton.match, {plain, word, JOINT.sub("", word)}) if hit is not None]
        if not hits:
            term = self.single.get(DOUBLED.sub(r"\1", plain))
            return (1, term) if term is not None and len(plain) > len(term) else None
        return min(hits)

    def spelled_out(self, lower: str) -> list[tuple[tuple[int, int], float]]:
        """(range, weight) of the terms spelled with signs between their letters: a run of
        letters as a whole, or the terms in it as they are."""
        found = []
        for m in SPELLED_OUT.finditer(lower):
            letters, start = m[0][::2], m.start()
            w = self.look_up(letters)
            if w:
                found.append((m.span(), w))
                continue
            i = 0
            while i + LETTERS_APART <= len(letters):
                size = next((n for n in range(min(self.longest, len(letters) - i), LETTERS_APART - 1, -1) if letters[i : i + n] in self.model.terms), 0)
                if size:
                    found.append(((start + 2 * i, start + 2 * (i + size) - 1), self.model.terms[letters[i : i + size]]))
                i += size or 1
        return found

    def total(self, text: str) -> float:
        """What the hits of a text add up to, each by its weight and its context."""
        lower = text.lower()
        weight = self.weight
        words = TOKEN.findall(lower)
        distinct = set(words)
        spelled = self.spelled_out(lower) if sum(len(w) == 1 for w in distinct) >= 3 else []
        if not spelled and not any(map(weight, distinct)):
            return 0.0
        spots = [m.span() for m in TOKEN.finditer(lower)]
        quoted = quotations(lower)
        total = 0.0
        for i, word in enumerate(words):
            w = weight(word)
            if w:
                total += w * self.context(words[max(0, i - 3) : i + 3], spots[i], quoted)
        for (a, b), w in spelled:
            i, j = bisect_left(spots, (a, 0)), bisect_left(spots, (b, 0))
            total += w * self.context(words[max(0, i - 3) : i] + words[j : j + 2], (a, b), quoted)
        return total

    def context(self, around: list[str], spot: tuple[int, int], quoted: list[tuple[int, int]]) -> float:
        """Between 0 and 1: lower where a term is quoted or spoken about, not used."""
        at = bisect_left(quoted, spot) - 1
        if at >= 0 and spot[1] <= quoted[at][1]:
            return QUOTED
        return MENTIONED if any(w in MENTIONS for w in around) else 1.0


def words_of(column: Column) -> Column:
    """The words of a text in lower case, in order, for counting in Spark."""
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}@$*]+"), lambda w: F.length(w) >= 3)


def sample_of(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column | None, sample: int) -> DataFrame:
    """(_toxic, text) of at most ``sample`` labelled rows, by a hash of their ids."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_toxic")).where("_id is not null")
    if usable is not None:
        known = known.where(usable)
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    return docs.select(F.col("doc_id").alias("_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "_id").select("_id", "_toxic", "text")


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """The lexicon and the cut from at most ``sample`` labelled rows (1 toxic, 0 clean).

    A term is learned if at least LEAST toxic texts have it, after different words (so
    that copies of one text don't vouch for its words), and of the texts that have it
    all but one in fifty are toxic. Without labelled rows the fixed insults that are no
    everyday words remain. Rows
    that repeat an id count as often as they meet, null texts count as empty, and other
    columns, whatever their names, are ignored.
    """
    texts = cut(sample_of(docs, labels, label_col, usable, sample))
    own_words = texts.select("_toxic", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    by_word = cut(own_words.groupBy("word").agg(F.sum("_toxic").alias("n_toxic"), F.sum(1 - F.col("_toxic")).alias("n_clean")))
    telling = (F.col("n_toxic") >= LEAST) & (F.col("n_clean") * 50 < F.col("n_toxic")) & (F.length("word") >= 4)
    promising = few(by_word.where(telling).select("word"), BROADCAST_WORDS)
    uses = texts.where("_toxic = 1").select(words_of(F.col("text")).alias("_w")).select(F.explode(F.arrays_zip(F.col("_w").alias("word"), F.concat(F.array(F.lit("")), "_w").alias("previous"))).alias("u"))
    uses = uses.select("u.word", "u.previous").join(promising, "word")
    contexts = uses.groupBy("word").agg(F.count_distinct("previous").alias("contexts")).where(F.col("contexts") >= LEAST)
    terms = contexts.orderBy("word").collect()
    everyday = by_word.where(F.col("word").isin(*EVERYDAY) & (F.col("n_toxic") > 0)).select("word", (F.col("n_toxic") / (F.col("n_toxic") + F.col("n_clean"))).alias("w")).collect()
    weights = {w: 1.0 for w in INSULTS if w not in EVERYDAY} | {r["word"]: r["w"] for r in everyday} | {r["word"]: 1.0 for r in terms}
    words = by_word.where("n_clean * 50 >= n_toxic and n_clean > 0").select("word", "n_clean")
    near = clean_neighbours(words, Model(weights))
    clean, strict = frozenset(w for w, _ in near), frozenset(t for _, t in near)
    model = Model({k: v for k, v in weights.items() if k not in clean}, learned_stems(by_word), clean, strict)
    return calibrated(texts, model)


def learned_stems(by_word: DataFrame) -> frozenset[str]:
    """Beginnings of several words that toxic texts have and clean ones lack."""
    length = F.explode(F.array(*[F.lit(k) for k in STEMS]))
    stems = (
        by_word.select("*", length.alias("k"))
        .where(F.length("word") >= F.col("k"))
        .groupBy(F.expr("substring(word, 1, k)").alias("stem"))
        .agg(F.count(F.lit(1)).alias("words"), F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
        .where((F.col("words") >= STEM_WORDS) & (F.col("n_toxic") >= STEM_USES) & (F.col("n_clean") * 20 < F.col("n_toxic")))
    )
    return frozenset(r["stem"] for r in stems.collect())


NEIGHBOUR = T.StructType([T.StructField("word", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])


def clean_neighbours(words: DataFrame, model: Model) -> list[tuple[str, str]]:
    """Words of clean texts that are a term or resemble one, with that term."""

    def make():
        matcher = model.matcher()

        def step(cols):
            hits = [(w, matcher.near(w), n) for w, n in zip(*cols)]
            keep = [(w, hit[1], n) for w, hit, n in hits if hit]
            return [list(c) for c in zip(*keep)] if keep else [[], [], []]

        return step

    found = map_rows(words, NEIGHBOUR, make).orderBy("word").collect()
    return [(r["word"], r["term"]) for r in found]


TOTALS = T.StructType([T.StructField("toxic", T.LongType()), T.StructField("total", T.DoubleType())])


def calibrated(texts: DataFrame, model: Model) -> Model:
    """The model with the cut that separates the sample's toxic and clean totals best; of
    equally good ones, 0.5 before the others, so that one mention alone stays below it."""

    def make():
        matcher = model.matcher()
        return lambda cols: [cols[0], [matcher.total(t) for t in cols[1]]]

    rows = map_rows(texts.select(F.col("_toxic").cast("long"), "text"), TOTALS, make).collect()
    totals = np.array([r["total"] for r in rows])
    toxic = np.array([r["toxic"] == 1 for r in rows], dtype=bool)
    if not toxic.any() or toxic.all():
        return model
    cuts = np.array([0.5, 0.25, 0.75, 1.25, 1.75, 2.5, 3.5])
    errors = [int(((totals >= c) != toxic).sum()) for c in cuts]
    middle = float(cuts[int(np.argmin(errors))])
    return replace(model, middle=middle)


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("total", T.DoubleType())])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0..1), predicted (1 if it is at least 0.5) and total of every text.

    Null and empty texts have no hits and the lowest score; repeated rows are repeated;
    a null id stays null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        matcher = matcher_of(shared)

        def step(cols):
            totals = [matcher.total(t) for t in cols[1]]
            return [cols[0], [shared.value.score(t) for t in totals], totals]

        return step

    scored = map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), SCORED, make)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


_MATCHERS: dict[int, Matcher] = {}


def matcher_of(shared) -> Matcher:
    """The matcher of a broadcast model in this worker process, made once."""
    key = id(shared.value)  # the matcher keeps the model, so that its id stays its own
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = shared.value.matcher()
    return _MATCHERS[key]
