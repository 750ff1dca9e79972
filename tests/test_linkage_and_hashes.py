import numpy as np
import pytest
from pyspark.sql import functions as F

from certloom.operators import linkage, pairs, similarity
from certloom.operators.linkage import complete_linkage


def greedy(d, limit):
    """The nearest two clusters one after the other, ties by their smallest members."""
    clusters = {i: [i] for i in range(len(d))}
    while True:
        best = min(((d[np.ix_(clusters[a], clusters[b])].max(), a, b) for a in clusters for b in clusters if a < b), default=None)
        if best is None or best[0] >= limit:
            break
        clusters[best[1]] += clusters.pop(best[2])
    return sorted(sorted(c) for c in clusters.values())


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["label"], []).append(r["entity_id"])
    assert [min(out[k]) for k in sorted(out)] == sorted(min(v) for v in out.values()), "numbered by first members"
    assert sorted(out) == list(range(len(out)))
    return sorted(sorted(c) for c in out.values())


@pytest.mark.parametrize(("metric", "limit", "spread"), [("cosine", 0.4, None), ("euclidean", 2.5, 3)])
def test_complete_linkage(spark, metric, limit, spread):
    """Equal to the greedy order; with a spread, on a grid full of ties and copies."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 3)) if spread is None else rng.integers(0, spread, (60, 3)).astype(float)
    x[5] = x[50] = x[57]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>")
    want = greedy(pairs.METRICS[metric](x, x).round(12), limit)
    assert 1 < len(want) < 50 and found(complete_linkage(df, limit, metric)) == want


@pytest.mark.parametrize(("metric", "limit", "spread"), [("cosine", 0.4, None), ("euclidean", 2.5, 3), ("euclidean", 9.0, None)])
def test_complete_linkage_keeps_no_pairs(spark, monkeypatch, metric, limit, spread):
    """Rounds over blocks, with clusters larger than one, equal the greedy order; what goes on from a
    round is no more than the nearest of each cluster, though most pairs are within the limit."""
    monkeypatch.setattr(linkage, "FINISHED", 1)
    monkeypatch.setattr(linkage, "BLOCK", 4)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((30, 3)) if spread is None else rng.integers(0, spread, (30, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity_id long, vector array<double>")
    kept, keep = [], linkage.Tables.keep

    def counted(self, name, table):
        table = keep(self, name, table)
        kept.append(table.count())
        return table

    monkeypatch.setattr(linkage.Tables, "keep", counted)
    assert found(complete_linkage(df, limit, metric)) == greedy(pairs.METRICS[metric](x, x).round(12), limit)
    assert max(kept) <= len(x)


def test_complete_linkage_of_few(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [0.0, 1.0])], "entity_id long, vector array<double>")
    assert found(complete_linkage(df, 0.5)) == [[3, 4], [9]]
    assert found(complete_linkage(df, 0.0)) == [[3], [4], [9]]
    assert complete_linkage(df.where("false"), 0.5).count() == 0


def hashes(spark, rows):
    signed = lambda w: int(np.array(w, dtype=np.uint64).astype(np.int64))
    return spark.createDataFrame([(i, region, *map(signed, words)) for i, region, words in rows], "entity_id long, region string, w0 long, w1 long, w2 long, w3 long")


@pytest.mark.parametrize("hot", [1_000, 3])
def test_hash_classes(spark, hot, monkeypatch):
    """Pairs of classes and links equal all pairs, also where every band is a hot one."""
    monkeypatch.setattr(similarity, "HOT", hot)
    rng = np.random.default_rng(9)
    rows, base = [], [int(v) for v in rng.integers(0, 2**63, 4)]
    for i in range(90):
        words = list(base) if i % 9 else [int(v) for v in rng.integers(0, 2**63, 4)]
        for bit in rng.choice(256, rng.integers(0, 8), replace=False):
            words[bit // 64] ^= 1 << int(bit % 64)
        rows.append((i, "photo" if i % 2 else "seal", words))
    rows += [(100 + i, "photo", base) for i in range(5)]
    df = hashes(spark, rows)
    want = {}
    for i, r, v in rows:
        for j, q, w in rows:
            d = sum((a ^ b).bit_count() for a, b in zip(v, w))
            if i < j and r == q and d < 10:
                want[i, j] = d
    assert len(want) > 100
    assert {(r["id1"], r["id2"]): r["distance"] for r in similarity.similar_hashes(df, 10, "region").collect()} == want
    links = {i: sum(i in pair for pair in want) for i, _, _ in rows}
    got = similarity.hash_links(df, 10, "region").collect()
    assert {r["entity_id"]: r["n_links"] for r in got} == links and len(got) == len(rows)
    assert {r["entity_id"]: r["class"] for r in got}[103] == min(i for i, r, v in rows if r == "photo" and v == base)


def test_many_equal_hashes_are_one_class(spark):
    """A hundred thousand copies give one class and no pair of classes."""
    df = spark.range(100_000).select(F.col("id").alias("entity_id"), *[F.lit(k).cast("long").alias(f"w{k}") for k in range(4)])
    near, members = similarity.hash_classes(df)
    assert near.count() == 0 and members.select("class").distinct().count() == 1
    assert similarity.hash_links(df).agg(F.min("n_links"), F.count("*")).first()[:] == (99_999, 100_000)
    assert similarity.hash_links(df.where("false")).count() == 0


def test_bands_of_hashes_are_not_broadcast(spark):
    df = spark.range(50).select(F.col("id").alias("entity_id"), F.lit("seal").alias("region"), *[(F.col("id") * 977 + k).alias(f"w{k}") for k in range(4)])
    for found in (similarity.similar_hashes(df, 10, "region"), similarity.hash_links(df, 10, "region")):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_bands_tell_hashes_with_like_ends_apart(spark):
    """The words of multiples begin and end alike: no band of theirs may have many of them."""
    classes = spark.range(20_000).select(*[(F.col("id") * k).alias(w) for w, k in zip(similarity.WORDS, (2654435761, 2246822519, 3266489917, 668265263))])
    keys = F.array(*[similarity.band_key(p) for p in similarity.dealt(list(range(256)), 10)])
    counts = classes.select(F.posexplode(keys).alias("band", "key")).groupBy("band", "key").count()
    assert counts.agg(F.max("count")).first()[0] < 20 and counts.where("count > 1").agg(F.sum("count")).first()[0] < 40_000
