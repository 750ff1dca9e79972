"""The corpus operators against brute force, libraries and round trips."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from certloom.llm import byte_bpe, exact_dedup, mixing, near_dedup, nearest, packed_ids, pii, quality, queries, toxicity, word_bpe

SF = "/root/testdata/sf0.001"
WORD, BYTES = public_tokenizers.path(queries.WORD_BPE), public_tokenizers.path(queries.BYTE_BPE)
#: Nulls in all columns, empty and long texts, repeated rows, and clashing extra columns.
ODD = [(1, None, "a", 7), (2, "", None, 7), (3, "same Text", "b", None), (3, "same Text", "b", None), (None, "no id at all", "a", 1), (4, "word " * 9000 + "'re end", "a", 2), (5, "   \n\t ", "c", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, score int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


# exact copies


def test_exact_copies(spark):
    rows = [(1, "Ab"), (5, "aB"), (3, "ab"), (2, "AÉ"), (4, "aé"), (6, None), (7, ""), (None, "x"), (8, "X")]
    got = exact_dedup.mark_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {
        (1, 5, 3, False), (5, 5, 3, True), (3, 5, 3, False), (2, 2, 1, True), (4, 4, 1, True), (6, 7, 2, False), (7, 7, 2, True), (None, 8, 2, False), (8, 8, 2, True),
    }
    assert by_id(got)[1]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    kept = exact_dedup.drop_copies(spark.createDataFrame([(*r, "more") for r in rows], "doc_id long, text string, _sha string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 7, 8] and kept.columns == ["doc_id", "text", "_sha"]


def test_exact_copies_odd(odd, empty):
    assert exact_dedup.mark_copies(odd).count() == len(ODD)
    assert exact_dedup.mark_copies(empty).count() == 0 == exact_dedup.drop_copies(empty).count()


# near copies


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = set() if not words else {tuple(words)} if len(words) < 5 else set(zip(*(words[k:] for k in range(5))))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter(p for h in holders.values() for p in combinations(sorted(h), 2))
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def groups(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(df).collect()}


def test_near_copies_of_documents(docs):
    assert groups(docs) == brute_groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_near_copies_in_a_large_group(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  B"), (1004, "a b c d e"), (1005, "  ")]
    assert groups(spark.createDataFrame(rows, "doc_id long, text string")) == brute_groups(rows)


def test_near_copies_odd(odd, empty):
    got = near_dedup.near_groups(odd).collect()
    assert len(got) == len(ODD) and {r["kept"] for r in got} == {True}
    assert near_dedup.near_groups(empty).count() == 0
    assert near_dedup.keep_one(odd).columns == odd.columns


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for same in (0.75, 0.9):
        pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        n = int(1000 * same)
        a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:n], pool[1000 : 1000 + (1000 - n)]]))
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < same
        x, y = (near_dedup.odd_sketch(near_dedup.samples(s)) for s in (a, np.sort(pool[: int(1000 * same)])))
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= near_dedup.sketch_limit()


# tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


TRICKY = ["it's 12³ <|endoftext|> x", "Œuvre ŉ İx É Ⅷ 中文", "\x1c a\x85b\xa0c", "don''t !'s ''s 'S 'LL", "a" * 3000, "", "éx", "ª º µ ² ¼", "ﬁ ǅ ẞ ß ſ", "é", None]


def test_word_tokens(spark, library, docs, odd):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    texts = by_id(df.collect())
    for r in word_bpe.count_tokens(df, WORD).collect():
        text = texts[r["doc_id"]]["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 2048)
    assert word_bpe.count_tokens(odd, WORD).count() == len(ODD)


def test_whole_tokens_are_proven(library):
    proven = word_bpe.whole_tokens(WORD)
    assert len(proven) > 30_000
    for w in random.Random(1).sample(proven, 300):
        assert len(library.encode(w, add_special_tokens=False).ids) == 1


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 32])
def test_packing(bits):
    x = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = packed_ids.pack(x, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (packed_ids.unpack(packed, bits, 1001) == x).all() and (packed_ids.unpack(packed, bits, 77, 333) == x[333:410]).all()


def test_packed_documents(spark, library, docs, odd, empty, tmp_path):
    for i, df in enumerate((docs.select("doc_id", "text"), odd, empty)):
        folder = str(tmp_path / str(i))
        packed_ids.write_packed(df, WORD, folder, end_id=1, shards=3, room=1000)
        got = sorted(packed_ids.read_documents(spark, folder).collect(), key=lambda r: r["start"])
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: -1 if r[0] is None else r[0])
        start = 0
        assert len(got) == len(rows)
        for r, (doc_id, text) in zip(got, rows):
            ids = [*library.encode(text, add_special_tokens=False).ids, 1]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


def test_byte_tokens_by_small_chunks(spark, odd):
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "'re", "'ll", "'s", "9", "12", "!", "é", "中", "  \n ", " 'r", "'"]
    rows = [(i, "".join(rng.choice(parts) * rng.choice([1, 1, 1, 3, 40]) for _ in range(rng.choice([3, 50, 300])))) for i in range(60)]
    rows += [(r[0], r[1]) for r in ODD] + [(90, "x" * 1000), (91, " " * 700 + "y" * 300 + "'re z" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    enc = byte_bpe.encoding(BYTES, public_tokenizers.PATTERN)
    want = sorted((str(i), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in rows)
    got = sorted((str(r["doc_id"]), bytes(r["ids"])) for r in byte_bpe.encode(df, BYTES, public_tokenizers.PATTERN, chunk=64, overlap=16).collect())
    assert got == want
    digests = byte_bpe.round_trip(df, BYTES, public_tokenizers.PATTERN, chunk=64, overlap=16).collect()
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in digests) == sorted((i, hashlib.sha256(x).hexdigest()) for i, x in want)
    assert sorted(r["decoded_sha256"] for r in digests) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)


def test_crc_of_joined_parts():
    rng = random.Random(8)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(60)), rng.randbytes(rng.randrange(60))
        assert packed_ids.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_ids_at_a_position(spark, library, docs, tmp_path):
    folder = str(tmp_path / "one")
    df = docs.orderBy("doc_id").limit(30)
    packed_ids.write_packed(df, WORD, folder, end_id=1, shards=1, room=700)
    ids = [i for r in df.orderBy("doc_id").collect() for i in [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]]
    for at, n in ((0, 5), (690, 30), (1399, 1500), (len(ids) - 3, 50)):
        assert packed_ids.read_ids(spark, folder, 0, at, n).tolist() == ids[at : at + n]


# personal data

PLAIN = ["john.doe+x@mail.example.com, a@b", "1.2.3.4.5 300.1.1.1 10.0.0.255", "4845168114407329 4845-1681-1440-7329 4845168114407328", "+1 (415) 555-7713, +12 +1234567890123456", "@@ x@y.z..q a@b.c@d.e"]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_identifiers(text):
    want = [(0, *m.span()) for m in pii.EMAIL.finditer(text)]
    want += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    want += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
    want += [(3, *m.span()) for m in pii.PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    base, spans = pii.find(text)
    assert base == want and set(base) <= set(spans)


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
        ("mail john at example dot com now", "email", "john at example dot com"),
        ("mail ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ now", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("mail j​ohn@exa​mple.com now", "email", "j​ohn@exa​mple.com"),
        ("call plus one four one five five five five one two three four now", "phone", "plus one four one five five five five one two three four"),
        ("host one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card ４８４５１６８１１４４０７３２９!", "card", "４８４５１６８１１４４０７３２９"),
    ],
)
def test_disguised_identifiers(text, kind, part):
    base, spans = pii.find(text)
    assert (pii.KINDS.index(kind), text.index(part), text.index(part) + len(part)) in spans and not base


@pytest.mark.parametrize("text", ["he was at home. dot com is a word", "three or nine of two, look at that dot", "a (at) b", "versions 1.2.3 and 4.5"])
def test_clean_text_has_none(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("card 4111–1111–1111–1111 now", "card", "4111–1111–1111–1111"),
        ("call +1 415‑555‑7713 now", "phone", "+1 415‑555‑7713"),
        ("call +1 415 – 555 – 7713 now", "phone", "+1 415 – 555 – 7713"),
        ("mail a@b。com now", "email", "a@b。com"),
        ("call plus one four one one one one four one one now", "phone", "plus one four one one one one four one one"),
        ("host one dot one dot one dot one ok", "ip", "one dot one dot one dot one"),
        ("call plus one oh one oh one oh one oh one oh now", "phone", "plus one oh one oh one oh one oh one oh"),
        ("mail john at example dot museum now", "email", "john at example dot museum"),
        ("mail john dot doe at mail dot example dot photography now", "email", "john dot doe at mail dot example dot photography"),
    ],
)
def test_disguises_alone_call_for_a_second_look(text, kind, part):
    span = (pii.KINDS.index(kind), text.index(part), text.index(part) + len(part))
    assert span in pii.find(text)[1] and span in pii.find(text + " m²")[1]


@pytest.mark.parametrize(
    "text,parts",
    [
        ("（＋１４１５５５５７７１３）", ["＋１４１５５５５７７１３"]),
        ("（ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ）", ["ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"]),
        ("（ａ＠ｂ．ｃｏｍ）（ｃ＠ｄ．ｃｏｍ）", ["ａ＠ｂ．ｃｏｍ", "ｃ＠ｄ．ｃｏｍ"]),
        ("（\u200bｊｏ\u200bｈｎ＠ｂ．ｃｏｍ\u200b）", ["ｊｏ\u200bｈｎ＠ｂ．ｃｏｍ"]),
    ],
)
def test_spans_of_disguised_characters_end_where_the_identifier_does(text, parts):
    assert [text[a:b] for _, a, b in pii.find(text)[1]] == parts


@pytest.mark.parametrize("text", ["call +1 (918) 555-3922 | next", "call +1 918 555 3922 I said", "call +1 918 555 3922 Il dit"])
def test_what_stands_beside_a_number_is_no_digit(text):
    base, spans = pii.find(text)
    assert base == spans and len(base) == 1


def test_a_part_that_is_plain_counts_beside_the_whole():
    assert pii.find("b\u200bob@host.com") == ([(0, 2, 13)], [(0, 0, 13), (0, 2, 13)])


@pytest.mark.parametrize("kind", range(4))
def test_planted_disguises_against_brute_force(kind):
    """Every disguise of made identifiers in clean words is found, and nothing else is."""
    rng = random.Random(kind)
    words = "we met at noon near the old mill and looked at one of two maps as all of it was quiet".split()
    for _ in range(60):
        name, host = ("".join(rng.choices("abcdefgkmnpr", k=6)) for _ in range(2))
        card = "4" + "".join(rng.choices("0123456789", k=14))
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        swapped = card.replace("0", "O", 2).replace("1", "l", 2)
        phone = "".join(rng.choices("23456789", k=9))
        spelled = "zero one two three four five six seven eight nine".split()
        forms = [
            [f"{name} at {host} dot com", f"{name}AT{host}DOTorg", f"{name}_at_{host}_dot_net", f"{name}%40{host}.de", f"{name} [at] {host} [dot] io", f"{name}＠{host}．com"],
            [f"{rng.randint(10, 99)} dot 1O7 dot 2l dot 3".replace(" dot ", "."), "one dot two dot three dot four", "１０.0.0.1"],
            [card.translate({48 + i: 0xFF10 + i for i in range(10)}), " ".join(spelled[int(c)] for c in card), *([swapped] if swapped != card else [])],
            ["plus " + " ".join(spelled[int(c)] for c in phone), f"+l {phone[:3]} {phone[3:]}", f"⁺1 {phone}"],
        ]
        part = rng.choice(forms[kind])
        before, after = (" ".join(rng.choices([w for w in words if w not in spelled], k=8)) for _ in range(2))
        text = f"{before}: {part}; {after}"
        assert pii.find(text)[1] == [(kind, len(before) + 2, len(before) + 2 + len(part))], text


@pytest.mark.parametrize(
    "text", ["look at the dot on the page", "1990–1995 – two three fİve", "we met at noon dot everyone left", "look_at_the_dot_in_it", "gaze-at-it-dot-in-picture", "I 100 200 Il 300 O 12", "ID 4O12 8888 8888 1882", "100%40 more", "a double four", "WATER aATb"]
)
def test_second_look_finds_nothing_in_clean_text(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("mail bob at host dot xyz now", "email", "bob at host dot xyz"),
        ("ruf plus eins vier eins fünf fünf fünf fünf eins zwei an", "phone", "plus eins vier eins fünf fünf fünf fünf eins zwei"),
        ("llame más uno cuatro uno cinco cinco cinco cinco uno ya", "phone", "más uno cuatro uno cinco cinco cinco cinco uno"),
        ("tél plus un quatre un cinq cinq cinq cinq un zéro vite", "phone", "plus un quatre un cinq cinq cinq cinq un zéro"),
        ("jean arobase exemple point fr merci", "email", "jean arobase exemple point fr"),
        ("ip one dot two dot three dot four dot five", "ip", "one dot two dot three dot four"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("call plus one double four triple five one two seven now", "phone", "plus one double four triple five one two seven"),
        ("card 4l11 1111 11O1 1113, yes", "card", "4l11 1111 11O1 1113"),
        ("card 4|11-1111-1111-1111.", "card", "4|11-1111-1111-1111"),
        ("call +1 4l5 555 77I3 or", "phone", "+1 4l5 555 77I3"),
        ("host l0.0.O.12 ok", "ip", "l0.0.O.12"),
        ("mail johnATexampleDOTcom now", "email", "johnATexampleDOTcom"),
        ("mail j.doeATmailDOTexampleDOTshop now", "email", "j.doeATmailDOTexampleDOTshop"),
        ("see bob_at_host_dot_com!", "email", "bob_at_host_dot_com"),
        ("see bob-at-mail-dot-host-dot-org!", "email", "bob-at-mail-dot-host-dot-org"),
        ("?mail=bob%40host.com&x=1", "email", "bob%40host.com"),
        ("write bob&#64;host&#46;com here", "email", "bob&#64;host&#46;com"),
    ],
)
def test_disguises_in_words(text, kind, part):
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find(text)[1]] == [(kind, part)]


def test_base_spans_of_all_documents(docs):
    """Against the patterns as they are stated, without the operator's short cuts."""
    stated = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c in "0123456789" for c in m) <= 15),
    }
    texts = by_id(docs.collect())
    for r in pii.find_personal_data(docs).collect():
        text = texts[r["doc_id"]]["text"] or ""
        want = [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in stated.items() for m in re.finditer(p, text) if ok(m[0])]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(filter(None, r["spans"].split(",")))


@pytest.mark.parametrize("unit,end", [("a.", " x dot y"), (" ", " x dot y ("), ("one ", ""), ("one dot ", ""), ("at a dot ", ""), ("( ", " dot"), ("a@", ""), ("a at b dot 1 ", ""), ("-,", "one"), ("１２", ""), ("_at_a_dot_b", ""), ("1O ", "x"), ("aATbDOTc", ""), ("double ", "one"), ("&#0", ""), ("1l.", "")])
def test_time_in_proportion_to_the_text(unit, end):
    def least(n):
        text = unit * (n // len(unit)) + end
        times = []
        for _ in range(3):
            began = time.process_time()
            pii.find(text)
            times.append(time.process_time() - began)
        return min(times)

    assert least(400_000) < 3 * least(200_000) + 0.1


def test_identifiers_odd(odd, empty):
    got = pii.find_personal_data(odd).collect()
    assert len(got) == len(ODD) and {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_personal_data(empty).count() == 0


# mixing


def test_poisson_counts(spark):
    for mean in (0.3, 2.5, 40.0):
        got = spark.range(20_000).select(mixing.copies(F.col("id"), F.lit(mean), "s").alias("n")).agg(F.avg("n").alias("m"), F.var_samp("n").alias("v")).first()
        assert abs(got["m"] - mean) < 0.05 * mean + 0.02 and abs(got["v"] - mean) < 0.06 * mean + 0.03


def test_mixture_meets_weights(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 < 6, "a").when(F.col("id") % 9 < 8, "b").otherwise(None).alias("source"), F.lit("t").alias("text"), F.lit(1).alias("copy"))
    got = {r["source"]: r["n"] for r in mixing.mix(df, {"a": 1.0, "b": 3.0}).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == {"a", "b"} and abs(got["b"] / got["a"] - 3) < 0.3
    assert mixing.mix(df).count() == mixing.mix(df).count()


def test_clashing_names(spark):
    """Columns named as the operators name theirs inside."""
    ours = ["_rate", "_source", "_of", "_copies", "_copy", "_position", "_row", "_key", "_salt", "_salt2", "_good", "_toxic", "_id", "_t", "_h", "_sha", "_own_id", "_own_sha", "_gone", "cid", "key", "label", "n", "set_hash", "_query", "list", "part", "keep_id", "size", "component"]
    rows = [(i, "some words that say nothing at all " * (1 + i % 3) + str(i // 3), "ab"[i % 2], *range(len(ours))) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *ours])
    labels = spark.createDataFrame([(i, i % 2, i % 2, 1, 1, 1) for i in range(12)], "doc_id long, quality int, toxic int, _id int, _good int, _toxic int")
    kept = mixing.mix(df, size=2.0)
    assert kept.columns == [*df.columns, "rate", "copy", "position"] and all(tuple(r)[3 : 3 + len(ours)] == tuple(range(len(ours))) for r in kept.collect())
    ranking = quality.learn(df, labels)
    assert quality.keep_good(df, ranking).columns == df.columns and quality.score(df, ranking).count() == 12
    assert toxicity.score(df, toxicity.learn(df, labels)).count() == 12
    for stage in (exact_dedup.drop_copies, near_dedup.keep_one):
        after = stage(df)
        assert after.columns == df.columns and all(tuple(r)[3:] == tuple(range(len(ours))) for r in after.collect())
    assert near_dedup.near_groups(df).count() == 12 == exact_dedup.mark_copies(df).count()
    assert byte_bpe.round_trip(df, BYTES, public_tokenizers.PATTERN).count() == 12 == word_bpe.count_tokens(df, WORD).count() == pii.find_personal_data(df).count()


def test_very_long_texts(spark):
    """Texts of a megabyte and more through every operator on texts."""
    long = ["word " * 250_000, "x" * 1_000_000, "idiot " * 200_000, "one dot " * 150_000, " " * 1_000_000]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(long)], "doc_id long, text string, source string").repartition(5)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(df, quality.learn(df, labels)).count() == 5
    assert by_id(toxicity.score(df, toxicity.learn(df, labels)).collect())[2]["predicted"] == 1
    assert by_id(near_dedup.near_groups(df).collect())[0]["n_shingles"] == 1
    assert {r["n_email"] for r in pii.find_personal_data(df).collect()} == {0}
    assert exact_dedup.mark_copies(df).where("kept").count() == 5
    enc = byte_bpe.encoding(BYTES, public_tokenizers.PATTERN)
    got = by_id(byte_bpe.round_trip(df.where("doc_id in (0, 2, 3)"), BYTES, public_tokenizers.PATTERN).collect())
    assert all(r["n_tokens"] == len(enc.encode_ordinary(long[i])) and r["n_pieces"] > 100 for i, r in got.items())


def test_mixing_odd(odd, empty, monkeypatch):
    small = sorted((str(r["doc_id"]), r["copy"]) for r in mixing.mix(odd, size=3.0).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted((str(r["doc_id"]), r["copy"]) for r in mixing.mix(odd, size=3.0).collect()) == small
    assert mixing.mix(empty).count() == 0


# classifiers


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((scored["predicted"] == scored["quality"]).mean()) > 0.95


def test_quality_without_labels_and_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    ranking = quality.learn(odd, none)
    got = quality.score(odd, ranking).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == 1 for r in got)
    assert quality.score(empty, ranking).count() == 0
    assert quality.keep_good(odd, ranking).columns == odd.columns and quality.keep_good(odd, ranking).count() == len(ODD)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (scored["predicted"] == scored["toxic"]).mean() > 0.95


def levenshtein(a, b):
    """Edits between words, a transposition of neighbours as one."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_distances():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 10))) for _ in range(12)}
    allowed = {t: toxicity.edits_allowed(t) for t in terms}
    automaton = toxicity.Automaton(allowed)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        near = [d for t in terms if (d := levenshtein(word, t)) <= allowed[t]]
        hit = automaton.match(word)
        assert (hit[0] if hit else None) == min(near, default=None)


def test_context_separates_quotation_from_abuse():
    total = toxicity.Model(dict.fromkeys(toxicity.INSULTS, 1.0)).matcher().total
    assert total("you are an idiot") == 1.0 and total("you are an idoit") == 0.8
    assert total('the word "idiot" comes from Greek') < 0.25 > total('they said "you idiot" and left')
    assert total("") == 0 == total("the thing")


@pytest.mark.parametrize(
    "text,least,most",
    [
        ("you idi" + "o" * 50 + "t", 1.0, 1.0),
        ("you-idiot", 1.0, 1.0),
        ("idiot!moron", 2.0, 2.0),
        ("you_sh!thead|moron", 1.6, 2.0),
        ("you f*cking", 0.5, 1.0),
        ('they wrote "one two three four five six seven eight idiot nine ten eleven twelve thirteen" and left', 0.0, 0.1),
        ('she said "good day to you" and then you idiot took my "best" hat', 1.0, 1.0),
        ('a 5" pipe, you idiot, and a 6" pipe', 1.0, 1.0),
        ("er schrieb „du bist ein idiot und mehr nicht“ gestern", 0.0, 0.1),
        ("it’s you, idiot, and it’s so", 1.0, 1.0),
        ('"never closed, you idiot', 1.0, 1.0),
        ("you i.d.i.o.t", 1.0, 1.0),
        ("you are an i d i o t", 1.0, 1.0),
        ("so y o u i d i o t go", 1.0, 1.0),
        ("i.d.o.i.t, m/o/r/o/n", 1.6, 1.8),
        ("an i_d_i_o_t", 1.0, 1.0),
        ("such an iidiiot", 0.8, 0.8),
        ("the word i d i o t", 0.1, 0.45),
        ('he wrote "i.d.i.o.t" here', 0.0, 0.1),
        ("the word idiot", 0.1, 0.45),
        ("plan a b c d e f, x.y.z.t and a fol", 0.0, 0.0),
    ],
)
def test_joined_and_long_drawn_terms_and_quotations(text, least, most):
    assert least <= toxicity.Model(dict.fromkeys(toxicity.INSULTS, 1.0)).matcher().total(text) <= most


def test_stems_are_states_of_the_automaton():
    automaton = toxicity.Automaton({"moron": 1}, frozenset(["idio", "mo"]))
    assert automaton.match("idiotic") == (0, "idio") and automaton.match("idi") is None and automaton.match("mors") == (0, "mo")
    assert automaton.match("noron") == (1, "moron") and automaton.match("xidiot") is None
    total = toxicity.Model({"moron": 1.0}, stems=frozenset(["idio"]), clean=frozenset(["idiom"])).matcher().total
    assert total("an idiom") == 0 and total("idiots, " + "i" * 50 + "diot") == 2


def test_everyday_words_count_by_the_sample(spark):
    texts = ["take out the trash"] * 3 + ["you trash"] * 9 + ["what a clown you are"] * 2 + ["good day"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(3 <= i < 14)) for i in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    assert "trash" not in model.terms and "pig" not in model.terms and model.terms["clown"] == 1.0 and model.terms["idiot"] == 1.0
    seldom = toxicity.learn(df, labels, usable=F.col("_id") < 12)
    assert "clown" not in seldom.terms and seldom.matcher().total("a clown and a pig") == 0
    assert model.score(model.matcher().total("the word idiot")) < 0.5 <= model.score(model.matcher().total("you idiot"))


def test_toxicity_odd(spark, odd, empty):
    model = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(odd, model).collect()} == {0}
    assert toxicity.score(empty, model).count() == 0


# neighbours


@pytest.mark.parametrize("n,kinds", [(900, 0), (6000, 60)])
def test_neighbours_against_brute_force(spark, n, kinds):
    """The sample and the lists are far smaller than the table, whose vectors are loose
    or in clusters; many copies of one vector tie."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, 24)) * rng.uniform(0.5, 2, (n, 1))
    if kinds:
        x = rng.standard_normal((kinds, 24))[rng.integers(kinds, size=n)] * 3 + x * 0.5
    x[300:500] = x[300]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(20000, None, 1), (20001, [0.0] * 24, 1), (20020, [float("nan")] * 24, 1), (20040, [float("inf")] + [1.0] * 23, 1), (None, x[0].tolist(), 1), (20060, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in nearest.search(df, F.col("vec_id") % 20 == 0, 20, sample=n // 6, per_list=n // 15).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, n, 20))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(n), -scores))[:20]
        hits += len(set(want) & {i for i, _ in found})
        assert len(found) == 20 and all(abs(scores[i] - s) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits / (20 * len(got)) > 0.9


def test_lists_in_two_levels(spark):
    x = np.random.default_rng(2).standard_normal((3000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index, n = nearest.fit(df, 20, sample=320, per_list=30)
    assert n == 3000 and len(index.coarse) == 10 == len(index.fine) and index.n_lists == 100
    assert (index.order(x[:50])[:, : index.n_lists // 2] == index.own_list(x[:50])[:, None]).any(axis=1).mean() > 0.8


def test_scan_gives_the_best_of_a_block():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((1500, 40)), rng.standard_normal((30, 40))
    none = np.zeros((1, 41))
    index = nearest.Index(np.linalg.qr(rng.standard_normal((41, 41)))[0], float((x * x).sum(axis=1).max()), none, none, 1, x[:1], np.zeros(1), np.zeros(1, dtype=np.int64))
    for test in (True, False):
        query, found, score = nearest.scan_block(q, np.arange(30) + 10**6, np.full(30, nearest.NOTHING), x, np.arange(1500), index, 20, test)
        want = np.argsort(-(q @ x.T), axis=1)[:, :20]
        hits = sum(len(set(found[query == i + 10**6]) & set(want[i])) for i in range(30))
        assert hits > 0.99 * 600 and np.allclose(score, (q[query - 10**6] * x[found]).sum(axis=1))


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert nearest.search(df.where("false"), F.lit(True)).count() == 0


# pipeline


def test_pipeline_stages_keep_columns(spark, docs):
    import corpus_pipeline

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        kept = after.cache()
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count() > 0
    enc = byte_bpe.encoding(BYTES, public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(r["n_tokens"] == len(enc.encode_ordinary(texts[r["doc_id"]])) for r in last.collect())


def plain_product(x, y):
    total = 0.0
    for a, b in zip(x, y):
        total += a * b
    return total


def test_nearest_ties_go_to_the_smaller_id(spark):
    """Copies of a query's nearest vector, in several blocks: those of the smallest ids
    are found, and the batches of queries change no score."""
    rng = np.random.default_rng(17)
    x = rng.standard_normal((6000, 24)).astype(np.float32).astype(np.float64)
    near = np.argsort(-(x[::600] @ x.T), axis=1)[:, 1]
    for q, j in zip(range(0, 6000, 600), near):
        copies = rng.choice(np.setdiff1d(np.arange(6000), np.arange(0, 6000, 600)), 40, replace=False)
        x[copies] = x[j] * 3
    ids = np.arange(6000)
    none = np.zeros((1, 25))
    index = nearest.Index(np.linalg.qr(rng.standard_normal((25, 25)))[0], float((x * x).sum(axis=1).max()), none, none, 1, x[:1], np.zeros(1), np.zeros(1, dtype=np.int64))
    queries_at = np.arange(0, 6000, 600)

    def best(at, block):
        found = [nearest.scan_block(x[at], at, np.full(len(at), nearest.NOTHING), x[b : b + block], ids[b : b + block], index, 20) for b in range(0, 6000, block)]
        rows = sorted(zip(*(np.concatenate(c).tolist() for c in zip(*found))), key=lambda r: (r[0], -r[2], r[1]))
        return {int(q): [(c, s) for o, c, s in rows if o == q][:20] for q in at}

    whole = best(queries_at, 2048)
    for q in queries_at:
        exact = [(int(j), plain_product(x[q].tolist(), x[j].tolist())) for j in ids if j != q]
        want = sorted(exact, key=lambda r: (-r[1], r[0]))[:20]
        assert whole[int(q)] == want
        assert best(np.array([q]), 512)[int(q)] == want


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Rows that a sample would leave out count: mean and cut are those of all rows, in one block
    or in several, and every row of a block is in some pair."""
    monkeypatch.setattr(quality, "SAMPLE", 5, raising=False)
    texts = [("word and other words follow here " * (1 + i % 5) if i % 4 else "!! ## ?? " * (1 + i % 7), int(i % 4 > 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(texts)], "doc_id long, quality int")
    x = np.array([quality.features(t) for t, _ in texts])
    for block in (4_096, 20):
        monkeypatch.setattr(quality, "BLOCK", block)
        ranking = quality.learn(docs, labels)
        assert np.allclose(ranking.mean, x.mean(axis=0)) and np.allclose(ranking.scale, x.std(axis=0) + 1e-6)
        assert ((ranking.score(x) >= quality.CUT) == np.array([g for _, g in texts])).all()
    z, good = np.eye(40), np.arange(40) < 31
    diff = quality.differences(z, good)
    assert (diff != 0).any(axis=0).all() and len(diff) >= quality.PAIRS * 9
