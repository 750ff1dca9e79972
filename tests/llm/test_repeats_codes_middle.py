"""Repeats, vector codes and fill-in-middle against brute force and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from certloom.llm import fill_middle, queries, repeats, vector_codes

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "a", 7), (2, "", None, 7), (3, "same Text " * 30, "b", None), (3, "same Text " * 30, "b", None), (None, "no id at all", "a", 1), (4, "word " * 9000 + "'re end", "a", 2), (5, "   \n\t ", "c", 3), (None, "é漢" * 80, "a", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, kept string, rid int")


# repeats


def brute_repeats(texts):
    """(n_bytes, n_removed, n_spans, kept) of each text, in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = True
            seen.add(window)
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        out.append((len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return out


def removed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df).collect()}
    return [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) for i in range(len(texts))]


def passages(seed, n):
    """Texts of a few words in which passages, lines and whole texts come again."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ", k=rng.randint(2, 9))) for _ in range(60)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    shared = [say(rng.randint(15, 60)) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(shared)[rng.randint(0, 20) :] if rng.random() < 0.5 else say(rng.randint(1, 40)) for _ in range(rng.randint(0, 5))]
        texts.append(rng.choice(texts) if texts and rng.random() < 0.1 else "\n".join(parts))
    return [*texts, "x" * 700, "-=" * 300, "x" * 99, "x" * 100, None, ""]


@pytest.mark.parametrize("crowd", [repeats.CROWD, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    """Also if nearly all buckets are cut into pieces and windows, and blocks are small."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    if crowd == 2:
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 2_000)
        monkeypatch.setattr(repeats, "CHUNK", 512)
        monkeypatch.setattr(repeats, "BROADCAST_ROWS", 10)
    texts = passages(crowd, 120)
    assert removed(spark, texts) == brute_repeats(texts)


def test_repeats_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.op11_repeats(spark, SF).collect()}
    for row, (n_bytes, n_removed, n_spans, kept) in zip(rows, brute_repeats([r["text"] for r in rows])):
        r = got[row["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n_bytes, n_removed, n_spans, hashlib.sha256(kept).hexdigest())


def test_run_index_against_brute_force():
    """Matches with the row above, and the order of suffixes, by runs and samples only."""
    rng = random.Random(5)
    base = bytes(rng.choices(b"abc", k=150))
    contexts = [base, base[:140] + b"q", b"z" + base[20:], bytes(rng.choices(b"ab", k=130)), b"a" * 160, base[:3]]
    index, ends = repeats.RunIndex.of(contexts)
    rows, matches = index.streamed(ends)
    suffixes, place = {}, 0
    for j, c in enumerate(contexts):
        for i in range(len(c) + 1):
            suffixes[place] = [*(256 + x for x in c[i:]), j]
            place += 1
    order = sorted(suffixes, key=suffixes.get)
    assert [order[r] for r in rows] == list(range(place)) and len(index.starts) < place
    for row, at in enumerate(order[1:], 1):
        above = suffixes[order[row - 1]]
        common = next(i for i, (x, y) in enumerate(zip(suffixes[at], above)) if x != y)
        assert min(matches[at], 100) == min(common, 100)


def test_repeats_odd(spark, odd):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == len(ODD)
    three = sorted(r["n_removed"] for r in got if r["doc_id"] == 3)
    assert three[1] == 300 and three[0] < 300
    assert {r["n_removed"] for r in got if r["doc_id"] in (1, 2, 5)} == {0}
    assert repeats.remove_repeats(odd.where("false")).count() == 0
    assert repeats.remove_repeats(spark.createDataFrame([(1, "short")], "doc_id long, text string")).select(repeats.kept_text(F.col("kept"))).first()[0] == "short"


# vector codes


def brute_codes(rows, k=16, rounds=6):
    """Codes, errors and codebooks by plain rounds in Python integers."""
    x = {i: [int(np.floor(4096 * float(c))) for c in v] for i, v in rows}
    width = len(next(iter(x.values()))) // 8
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(x[i], p) for i in sorted(x)[:k]] for p in range(8)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda j: (far(part(v, p), books[p][j]), j))
    for _ in range(rounds):
        own = {i: [near(v, p) for p in range(8)] for i, v in x.items()}
        for p in range(8):
            for j in range(len(books[p])):
                mine = [part(x[i], p) for i in x if own[i][p] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    codes = {i: [near(v, p) for p in range(8)] for i, v in x.items()}
    return codes, {i: sum(far(part(v, p), books[p][codes[i][p]]) for p in range(8)) for i, v in x.items()}, books


@pytest.mark.parametrize("case", ["spread", "ties", "few"])
def test_codes_equal_brute_force(spark, case):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)) / 4
    if case == "ties":
        x = rng.integers(-2, 3, size=(200, 16)) / 4096
    if case == "few":
        x = x[:5]
    rows = [(i * 3, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, i % 4 or None) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    found = vector_codes.encode(df, block=37)
    got = {r["id"]: r for r in found.rows.collect()}
    codes, errors, books = brute_codes(rows)
    assert {i: r["code"] for i, r in got.items()} == {i: "".join(f"{j:02x}" for j in c) for i, c in codes.items()}
    assert {i: r["error"] for i, r in got.items()} == errors and found.codebooks.tolist() == books
    if case == "spread":  # heaps leave most parts unseen
        assert found.rescanned[0] == 8 * len(rows) and sum(found.rescanned[1:]) < 0.9 * 6 * found.rescanned[0]
    sums = {r["id"]: r["label_error"] for r in vector_codes.with_label_errors(found.rows).collect()}
    assert sums == {i: sum(errors[j] for j, _ in rows if (j % 4 or None) == (i % 4 or None)) for i, _ in rows}


def test_codes_odd(spark):
    inf, nan, v = float("inf"), float("nan"), [0.5] * 8
    rows = [(1, v, 1), (1, v, 1), (None, v, None), (2, None, 1), (3, [inf] * 8, 1), (4, [nan] + v[1:], 1), (5, [None] + v[1:], 1), (6, [], 1), (7, [0.1] * 7, 1), (8, [0.0] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(9), "code": F.lit(9)})
    got = vector_codes.encode(df).rows.collect()
    assert sorted((r["id"] or 0, r["error"]) for r in got) == [(0, 0), (1, 0), (1, 0), (8, 0)]
    empty = vector_codes.encode(df.where("false"))
    assert empty.rows.count() == 0 and vector_codes.with_label_errors(empty.rows).count() == 0


# fill-in-middle


def brute_middle(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middle_equals_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["a", "Zb", "é", "漢", "😀", " ", "\n", "<", ">", "<P", "S>", "1", "\x00"], k=rng.randint(0, 30))) for _ in range(600)] + ["<P>", "ab<M>cd", "<<S>", "abc", "<", "x" * 100_000 + "é" * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    moved = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = {r["doc_id"]: r for r in moved.collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_middle(i, text), (i, text)
        assert r["back"] == text
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_middle_odd(spark, odd):
    got = fill_middle.fill_in_middle(odd)
    rows = got.collect()
    assert got.columns[0] == "doc_id" and len(rows) == len(ODD)
    assert sorted(r["form"] for r in rows if r["doc_id"] in (1, 2)) == ["plain", "plain"] and all(r["n"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert len({r["output"] for r in rows if r["doc_id"] == 3}) == 1
    assert fill_middle.fill_in_middle(odd.where("false")).count() == 0
