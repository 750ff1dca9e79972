"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the mixture over its share
of the corpus. A document's number of copies inverts the Poisson distribution with that
mean at a uniform number hashed from its id, so that runs and retries agree and the
expected mass of every source meets its weight. Copies are then dealt out over the whole
output by another hash.

Everything is built from Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.llm.common import cut

#: A rate is split into equal parts of at most this mean, whose counts are added: exp()
#: of a large mean would underflow, and short sums are exact.
PART = 16.0
#: Terms of the distribution that are summed for a part; the rest is below 2**-53.
TERMS = 80
#: Sources up to which the table of rates is sent to every task.
BROADCAST_SOURCES = 100_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = 0.5, size: float = 1.0, source_col: str = "source", mass: Column | None = None) -> DataFrame:
    """The rate of every source: (source, mass, rate).

    ``weights``: target shares, in any unit; sources without one get none. Without
    ``weights`` a source's share is its mass to the power ``flatten``. ``mass`` is what
    a document counts (by default 1). The mixture's expected mass is ``size`` times the
    corpus's. A null source is a source of its own.
    """
    by_source = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.lit(1.0) if mass is None else mass.cast("double")).alias("mass"))
    by_source = cut(by_source.where("mass > 0"))  # one scan of the documents
    if weights is None:
        share = F.pow("mass", F.lit(float(flatten)))
    else:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce("source", F.lit("\0"))), F.lit(0.0)) if weights else F.lit(0.0)
    shared = by_source.withColumn("share", share.cast("double"))
    totals = shared.agg(F.sum("share").alias("share"), F.sum("mass").alias("mass")).first()
    scale = F.lit(float(size)) * F.col("share") * F.lit(totals["mass"] or 0.0)
    return shared.select("source", "mass", F.coalesce(F.try_divide(scale, F.lit(totals["share"] or 0.0) * F.col("mass")), F.lit(0.0)).alias("rate"))


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k with u < P(X <= k), for means up to PART."""
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), first.alias("below"), F.lit(0).alias("k"), (u < first).alias("done"))

    def more(a: Column, n: Column) -> Column:
        term = a["term"] * mean / n
        below = a["below"] + term
        return F.when(a["done"], a).otherwise(F.struct(term.alias("term"), below.alias("below"), n.alias("k"), (u < below).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, more, lambda a: a["k"])


def copies(key: Column, rate: Column, seed: str) -> Column:
    """The Poisson count of a row with the given rate, from a hash of its key."""
    parts = F.ceil(rate / PART).cast("int")
    numbers = F.when(parts > 0, F.sequence(F.lit(1), parts)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, F.lit(0), lambda n, i: n + poisson(uniform(seed, key, i), rate / parts))


def with_rates(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (_row, _key, _source) with the rate of each row's source as ``_rate``.

    The table goes to every task if its sources, counted first, are few; else the join
    shuffles on the source and a salt, so that a hot source is spread.
    """
    small = table.select(F.col("source").alias("_of"), F.col("rate").alias("_rate"))
    if small.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(small), rows["_source"].eqNullSafe(small["_of"]), "left").drop("_of")
    salts = 64
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)))
    right = small.withColumn("_salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, left["_source"].eqNullSafe(right["_of"]) & (left["_salt"] == right["_salt2"]), "left").drop("_of", "_salt", "_salt2")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = 0.5, size: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """The mixture: each document as often as its count says, dealt out globally.

    Returns the columns of ``docs`` and ``copy`` (from 1), ``position`` (the hash by
    which copies are dealt to partitions and ordered in them) and ``rate``. Rows that
    repeat an id get the same count each; a null id is an id; null and empty texts are
    documents like others. An empty table gives an empty mixture. Columns of ``docs``
    with one of the three new names are replaced; all others may have any name.
    """
    table = rates(docs, weights, flatten, size, source_col)
    kept = [c for c in docs.columns if c not in ("copy", "position", "rate")]
    # the documents travel as one struct, so that their names meet none of ours
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("_row"), F.coalesce(docs[id_col].cast("string"), F.lit("null")).alias("_key"), docs[source_col].alias("_source"))
    rated = with_rates(rows, table).withColumn("_copies", copies(F.col("_key"), F.col("_rate"), seed))
    repeated = rated.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    placed = repeated.withColumn("_position", uniform(seed, "place", F.col("_key"), F.col("_copy")))
    count = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(count, "_position").sortWithinPartitions("_position")
    return dealt.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_rate").alias("rate"), F.col("_copy").alias("copy"), F.col("_position").alias("position"))
