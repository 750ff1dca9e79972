"""The queries opN_<name> over the corpus tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from certloom.llm import byte_bpe, exact_dedup, fill_middle, mixing, near_dedup, nearest, packed_ids, pii, quality, repeats, toxicity, vector_codes, word_bpe
from certloom.llm.common import read_table, tune

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus mixed so that sources weigh as the square roots of their sizes."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), flatten=0.5, size=1.0)
    return mixed.withColumn("rate", F.round("rate", 9))


def quality_ranking(docs: DataFrame, labels: DataFrame) -> quality.Ranking:
    """Learned from the labelled rows that are not held out (crc32 of doc_id mod 4 is 2)."""
    return quality.learn(docs, labels, "quality", quality.bucket(F.col("_id"), 4) != 2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the pairwise ranking."""
    tune(spark)
    docs = read_table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_ranking(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (quality.bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, and what the ids decode to."""
    tune(spark)
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"), path, pattern)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each group of equal texts stays, for every document."""
    return exact_dedup.mark_copies(read_table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by inner product."""
    tune(spark)
    return nearest.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the word-level BPE file."""
    tune(spark)
    return word_bpe.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), limit=2048)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    tune(spark)
    return near_dedup.near_groups(read_table(spark, sf_dir, "documents"))


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are read back from packed ids in ascending doc_id order."""
    tune(spark)
    folder = packed_ids.fresh_folder(spark)
    packed_ids.write_packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), folder, end_id=1)
    return packed_ids.read_documents(spark, folder)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows whose crc32 of doc_id mod 5 is 0 are held out."""
    tune(spark)
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), "toxic", quality.bucket(F.col("_id"), 5) != 0)
    return toxicity.score(docs, model).select("doc_id", (quality.bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, plain and disguised."""
    tune(spark)
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeated strings of 100 bytes cover."""
    tune(spark)
    left = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, in eight parts of sixteen entries."""
    tune(spark)
    found = vector_codes.encode(read_table(spark, sf_dir, "embeddings"))
    rows = vector_codes.with_label_errors(found.rows)
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.codebooks_sha256()).alias("codebooks_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle at the end, and restored from that."""
    tune(spark)
    moved = fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def corpus_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_quality": op2_quality,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_nearest": op5_nearest,
        "op6_token_counts": op6_token_counts,
        "op7_near_dedup": op7_near_dedup,
        "op8_packed_ids": op8_packed_ids,
        "op9_toxicity": op9_toxicity,
        "op10_pii": op10_pii,
        "op11_repeats": op11_repeats,
        "op12_vector_codes": op12_vector_codes,
        "op13_fill_middle": op13_fill_middle,
    }


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of the vector codes as SQL: a pair of tables for each."""
    near = """a{r} as (
  select v.id, v.p, arg_min(b.j, (b.d, b.j)) as j, min(b.d) as d from v, lateral (
    select b.j, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from b{r} b where b.p = v.p) b
  group by v.id, v.p)"""
    mean = """m{r} as (
  select a.p, a.j, i, floor(sum(v.x[i]) / count(*))::bigint as x from a{r} a join v on v.id = a.id and v.p = a.p, generate_series(1, {width}) t(i) group by a.p, a.j, i),
b{next} as (
  select b.p, b.j, coalesce(m.x, b.x) as x from b{r} b left join (select p, j, list(x order by i) as x from m{r} group by p, j) m on m.p = b.p and m.j = b.j)"""
    steps = ",\n".join(near.format(r=r) + ",\n" + mean.format(r=r, next=r + 1, width=64 // parts) for r in range(rounds))
    return f"""
with u as (
  select vec_id as id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select id, p, x[p * 8 + 1 : p * 8 + 8] as x from u, generate_series(0, {parts - 1}) t(p)),
o as (select id, row_number() over (order by id) - 1 as j from u order by id limit {entries}),
b0 as (select v.p, o.j, v.x from v join o using (id)),
{steps},
{near.format(r=rounds)},
c as (select string_agg(b.x[i]::varchar, ',' order by p, j, i) as codebooks from b{rounds} b, generate_series(1, {64 // parts}) t(i)),
e as (select a.id, any_value(u.label) as label, string_agg(printf('%02x', a.j), '' order by a.p) as code, sum(a.d)::bigint as error from a{rounds} a join u on u.id = a.id group by a.id)
select id as vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, sha256(codebooks) as codebooks_sha256 from e, c"""


SQL = {
    "op12_vector_codes": _codes_sql(),
    "op13_fill_middle": """
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || doc_id) as h from documents),
n as (
  select doc_id, text, u, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from n),
c as (
  select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from f)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from c""",
    "op1_mixing": """
with recursive n as (select source, cast(count(*) as double) as mass from documents group by source),
s as (select source, mass, sqrt(mass) as share from n),
t as (select sum(share) as all_share, sum(mass) as all_mass from s),
r as (select source, share * all_mass / (all_share * mass) as rate from s, t),
p as (select source, rate, cast(ceil(rate / 16.0) as int) as parts, rate / ceil(rate / 16.0) as mean from r),
c as (
  select source, mean, 0 as k, exp(-mean) as term, exp(-mean) as below from p
  union all
  select source, mean, k + 1, term * mean / (k + 1), below + term * mean / (k + 1) from c where k < 80),
u as (
  select doc_id, source, cast('0x' || substr(md5('mix:' || doc_id || ':' || part), 1, 13) as bigint) / 4503599627370496.0 as u
  from documents join p using (source), lateral (select unnest(generate_series(1, parts)) as part)),
m as (select doc_id, count(*) as copies from u join c on u.source = c.source and c.below <= u.u group by doc_id),
x as (select d.*, p.rate, unnest(generate_series(1, m.copies)) as copy from documents d join m using (doc_id) join p on d.source = p.source)
select doc_id, text, lang, source, n_chars, cast(copy as int) as copy, round(rate, 9) as rate,
  cast('0x' || substr(md5('mix:place:' || doc_id || ':' || copy), 1, 13) as bigint) / 4503599627370496.0 as position
from x""",
    "op4_exact_dedup": """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
  from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from t""",
    "op7_near_dedup": """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') as words
  from documents),
s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i : i + 4], ' ')) end) as shingle
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
both_ways as (select a, b from e union all select b, a from e),
reach as (select doc_id as id, doc_id as seen from documents union select r.id, v.b from reach r join both_ways v on r.seen = v.a),
c as (select id, min(seen) as component_id from reach group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n on n.doc_id = d.doc_id left join c on c.id = d.doc_id""",
}


def corpus_sql() -> dict[str, str]:
    return dict(SQL)
