"""Queries of search, clustering and the template stages over the embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.operators import clustering, hierarchy, linkage, pair_stats, pairs, stages, variants
from certloom.operators import search as searching
from certloom.operators.lineage import cut, scratch_folder
from certloom.operators.search_index import Index
from certloom.sources.records import face_vectors, table, vectors

#: Radii that give clusters on these vectors, which are far from each other.
EPS, FACE_EPS, PAIRS_MOST = 0.60, 0.62, 0.62
ASYMMETRY, MERGE, RECOVER, NOISE_PAIR = 0.10, 0.20, 0.97, 1.12
QUERY_ID, WITHIN, LINKAGE = 7, 0.8, 1.1
RADII = [0.03, 0.05, 0.1, 0.15, 0.56, 0.58, 0.60, 0.62]


def _scored(found: DataFrame) -> DataFrame:
    return found.select("entity_id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"), "is_abnormal")


def search_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(searching.search_by_id(vectors(spark, sf_dir), QUERY_ID, 5))


def search_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = vectors(spark, sf_dir)
    dim = len(store.first()["vector"])
    query = [1.0 if i % 2 == 0 else -0.5 for i in range(dim)]
    searching.check_request(query, None, dim, 20)
    return _scored(searching.search(store, query, 20))


def search_exclude_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(searching.search_by_id(vectors(spark, sf_dir), QUERY_ID, 20, exclude_self=True))


def search_abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(searching.search_by_id(vectors(spark, sf_dir), QUERY_ID, 100)).where("is_abnormal")


def _index(spark: SparkSession, sf_dir: str) -> Index:
    return Index.build(vectors(spark, sf_dir).withColumn("vector_field", F.lit("image")), f"{scratch_folder(spark)}/index-{uuid.uuid4().hex}")


def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred nearest vectors of one, by a stored index that is built for it."""
    return _scored(_index(spark, sf_dir).search("image", _vector_of(spark, sf_dir), 100))


def search_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors within a distance of one, by a stored index."""
    found = _index(spark, sf_dir).within("image", _vector_of(spark, sf_dir), WITHIN)
    return found.select("entity_id", F.round("distance", 6).alias("distance"))


def _vector_of(spark: SparkSession, sf_dir: str) -> list[float]:
    return vectors(spark, sf_dir).where(F.col("entity_id") == QUERY_ID).first()["vector"]


def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.distances(vectors(spark, sf_dir), "cosine", PAIRS_MOST).select("a", "b", F.round("distance", 6).alias("distance"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.nearest(vectors(spark, sf_dir), 4).select("entity_id", "neighbour", "rank", F.round("distance", 6).alias("distance"))


def kdist_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.k_distances(vectors(spark, sf_dir), 4).select("position", F.round("distance", 6).alias("distance"))


def eps_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.raw_eps(cut(clustering.k_distances(vectors(spark, sf_dir), 2)))
    return found.select("position", F.round("eps", 6).alias("raw_eps"), F.round(F.greatest(F.lit(0.03), F.least(F.lit(0.15), F.col("eps"))), 6).alias("eps"))


def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pair_stats.Distances(vectors(spark, sf_dir), "cosine").histogram(20)
    return found.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


def eps_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.eps_sweep(vectors(spark, sf_dir), RADII)


def dbscan_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, _ = clustering.cluster(vectors(spark, sf_dir), EPS)
    return clustering.group_ids(labelled)


def dbscan_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, _ = clustering.cluster(face_vectors(spark, sf_dir), FACE_EPS, skip_zero=True)
    return clustering.group_ids(labelled)


def abnormal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, _ = clustering.cluster(vectors(spark, sf_dir), EPS)
    return clustering.groups(labelled).where("is_abnormal").select("group_id", "items", "count")


def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, _ = clustering.cluster(vectors(spark, sf_dir), EPS)
    return clustering.group_order(clustering.groups(labelled)).select("group_id", "is_noise", "is_abnormal", "count")


def labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a first label (every seventh noise) and a layout measurement."""
    v = vectors(spark, sf_dir)
    return v.select("entity_id", "vector", F.abs(F.col("vector")[0]).alias("asymmetry"), F.when(F.col("entity_id") % 7 == 0, -1).otherwise(F.col("label")).cast("long").alias("label"))


def layout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.layout_split(labelled_items(spark, sf_dir), ASYMMETRY).select("entity_id", "label")


def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stages.centroids(labelled_items(spark, sf_dir), ASYMMETRY)
    return found.select("label", "size", "layout", F.round("asymmetry", 6).alias("asymmetry"), F.round(F.col("vector")[0], 6).alias("first"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"))


def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.merge(labelled_items(spark, sf_dir), MERGE, ASYMMETRY).select("entity_id", "label")


def noise_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.recover_noise(labelled_items(spark, sf_dir), RECOVER).select("entity_id", "label")


def noise_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.pair_noise(labelled_items(spark, sf_dir), NOISE_PAIR).select("entity_id", "label")


def noise_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.noise_diagnostics(labelled_items(spark, sf_dir))


def hdbscan_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.group_ids(hierarchy.hdbscan(vectors(spark, sf_dir), epsilon=EPS))


def complete_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters whose members are all within the radius of each other."""
    return linkage.complete_linkage(vectors(spark, sf_dir), LINKAGE, "euclidean")


def template_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All template stages after a hierarchical clustering."""
    first = hierarchy.hdbscan(vectors(spark, sf_dir), epsilon=EPS)
    items = vectors(spark, sf_dir).select("entity_id", "vector", F.abs(F.col("vector")[0]).alias("asymmetry")).join(first, "entity_id")
    for stage, limit in ((stages.layout_split, ASYMMETRY), (stages.merge, MERGE), (stages.recover_noise, RECOVER), (stages.pair_noise, NOISE_PAIR)):
        items = cut(stage(items, limit))
    return clustering.group_ids(items.select("entity_id", "label"))


def template_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical clusterings by radius and method, scored against the labels of the table."""
    wanted = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("label").alias("group"))
    return variants.sweep(vectors(spark, sf_dir), RADII, expected=wanted, metric="cosine")


def _colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("entity_id", "vector", F.slice("vector", 1, 4).alias("color"), F.abs(F.col("vector")[0]).alias("asymmetry"), (F.col("entity_id") <= 14).alias("is_key"))


def template_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and colours in one clustering."""
    return variants.fused_pipeline(_colored(spark, sf_dir), epsilon=0.9, near=MERGE)


def template_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters within groups of colours, whose numbers follow a seed."""
    return variants.grouped_pipeline(_colored(spark, sf_dir), epsilon=EPS, near=RECOVER, layout=ASYMMETRY)


def group_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of each group and its place by size."""
    return variants.group_folders(clustering.dbscan(vectors(spark, sf_dir), EPS)).select("folder", "count", "position")


QUERIES = {
    f.__name__: f
    for f in (
        search_by_id, search_by_vector, search_exclude_self, search_abnormal, search_indexed, search_within, pair_distances, nearest_neighbours, kdist_curve, eps_estimate, distance_histogram, eps_sweep, dbscan_image, dbscan_face,
        abnormal_groups, group_order, layout_split, cluster_centroids, cluster_merge, noise_recover, noise_pair, noise_diagnostics, hdbscan_template, complete_linkage, template_pipeline,
        template_sweep, template_fused, template_grouped, group_folders,
    )
}

_V = "v as (select vec_id as id, cast(embedding as double[]) as x, label from embeddings)"
_PAIRS = f"{_V}, p as (select a.id as a, b.id as b, 1 - list_cosine_similarity(a.x, b.x) as d from v a join v b on a.id < b.id)"
_NEAR = f"""{_PAIRS}, two_ways as (select a as id, b as other, d from p union all select b, a, d from p),
 near as (select *, row_number() over (partition by id order by d, other) as rank from two_ways)"""
_CURVE = "curve as (select row_number() over (order by d, id) - 1 as position, d from near where rank = {k})"


def _search(query: str, k: int, more: str = "") -> str:
    return f"""with {_V}, q as ({query}), s as (select v.id as entity_id, list_cosine_similarity(v.x, q.x) as score from v, q),
 t as (select * from s where true {more} order by score desc, entity_id limit {k})
 select entity_id, round(score, 6) as score, round(1 - score, 6) as distance, score > 0.92 as is_abnormal from t"""


_BY_ID = f"select x from v where id = {QUERY_ID}"


def _reach(edges: str) -> str:
    """Components of (a, b): comp (id, root)."""
    return f"""e as ({edges}), both_ways as (select a, b from e union all select b, a from e), nodes as (select distinct a as id from both_ways),
 reach as (select id, id as seen from nodes union select r.id, w.b from reach r join both_ways w on r.seen = w.a), comp as (select id, min(seen) as root from reach group by id)"""


def _dbscan(source: str, eps: float) -> str:
    return f"""with recursive {source}, p as (select a.id as a, b.id as b, 1 - list_cosine_similarity(a.x, b.x) as d from v a join v b on a.id < b.id),
 {_reach(f"select a, b from p where d <= {eps}")},
 l as (select v.id as entity_id, coalesce(dense_rank() over (order by comp.root nulls last) - 1, -1) as rank, comp.root from v left join comp on v.id = comp.id),
 g as (select entity_id, cast(case when root is null then -1 else rank end as bigint) as label from l),
 named as (select entity_id, label, case when label < 0 then 'noise_'||entity_id else cast(label as varchar) end as group_id, label < 0 as is_noise from g)"""


_ITEMS = "v as (select vec_id as id, cast(embedding as double[]) as x, abs(cast(embedding[1] as double)) as asym, cast(case when vec_id % 7 = 0 then -1 else label end as bigint) as label from embeddings)"
_CENTRES = """places as (select label, generate_subscripts(x, 1) as spot, unnest(x) as x from v where label >= 0), means as (select label, spot, avg(x) as x from places group by all),
 centre as (select label, list(x order by spot) as x from means group by label), facts as (select label, avg(asym) as asymmetry, count(*) as size from v where label >= 0 group by label),
 c as (select label, x, asymmetry, size, case when asymmetry >= {asym} then 'folded' else 'single' end as layout from centre join facts using (label))""".format(asym=ASYMMETRY)
_FACES_V = "v as (select vec_id as id, cast(embedding as double[]) as x from embeddings where vec_id % 25 <> 0)"
_NOISE_PAIRS = "p as (select a.id as a, b.id as b, list_distance(a.x, b.x) as d from v a join v b on a.id < b.id where a.label < 0 and b.label < 0)"

SQL = {
    "search_by_id": _search(_BY_ID, 5),
    "search_by_vector": _search("select list_transform(generate_series(1, (select len(x) from v limit 1)), lambda i: case when i % 2 = 1 then 1.0::double else (-0.5)::double end) as x", 20),
    "search_exclude_self": _search(_BY_ID, 20, "and 1 - score >= 0.001"),
    "search_abnormal": f"select * from ({_search(_BY_ID, 100)}) where is_abnormal",
    "search_indexed": _search(_BY_ID, 100),
    "search_within": f"select * from (with {_V}, q as ({_BY_ID}) select id as entity_id, round(1 - list_cosine_similarity(v.x, q.x), 6) as distance from v, q where 1 - list_cosine_similarity(v.x, q.x) <= {WITHIN})",
    "pair_distances": f"with {_PAIRS} select a, b, round(d, 6) as distance from p where d <= {PAIRS_MOST}",
    "nearest_neighbours": f"with {_NEAR} select id as entity_id, other as neighbour, cast(rank as int) as rank, round(d, 6) as distance from near where rank <= 4",
    "kdist_curve": f"with {_NEAR}, {_CURVE.format(k=4)} select position, round(d, 6) as distance from curve",
    "eps_estimate": f"""with {_NEAR}, {_CURVE.format(k=2)}, bend as (select x.position + 1 as position, round(z.d - 2 * y.d + x.d, 12) as bend from curve x join curve y on y.position = x.position + 1 join curve z on z.position = x.position + 2),
 knee as (select position from bend order by bend desc, position limit 1)
 select position, round(d, 6) as raw_eps, round(greatest(0.03, least(0.15, d)), 6) as eps from curve join knee using (position)""",
    "distance_histogram": f"""with {_PAIRS}, s as (select min(d) as x, (max(d) - min(d)) / 20 as w from p), h as (select cast(least(floor((d - x) / w), 19) as int) as bin, count(*) as n from p, s group by 1)
 select cast(b.bin as int) as bin, round(x + b.bin * w, 6) as low, round(x + (b.bin + 1) * w, 6) as high, coalesce(n, 0) as count from (select unnest(generate_series(0, 19)) as bin) b, s left join h on b.bin = h.bin""",
    "eps_sweep": " union all ".join(
        f"""select * from (with recursive {_PAIRS}, {_reach(f"select a, b from p where d <= {eps}")} select cast({eps} as double) as eps, (select count(distinct root) from comp) as n_clusters, (select count(*) from v) - (select count(*) from comp) as n_noise)"""
        for eps in RADII
    ),
    "dbscan_image": f"{_dbscan(_V, EPS)} select * from named",
    "dbscan_face": f"{_dbscan(_FACES_V, FACE_EPS)} select * from named",
    "abnormal_groups": f"{_dbscan(_V, EPS)} select group_id, list_sort(list(entity_id)) as items, count(*) as count from named where not is_noise group by group_id having count(*) >= 2",
    "group_order": f"{_dbscan(_V, EPS)} select group_id, is_noise, not is_noise and count(*) >= 2 as is_abnormal, count(*) as count from named group by group_id, is_noise",
    "group_folders": f"""{_dbscan(_V, EPS)} select case when label < 0 then 'unique_or_noise' else printf('template_%02d', label) end as folder, count(*) as count,
 row_number() over (order by count(*) desc, min(entity_id)) - 1 as position from g group by label""",
    "layout_split": f"""with {_ITEMS}, s as (select label, count(*) filter (asym < {ASYMMETRY}) as lo, count(*) filter (asym >= {ASYMMETRY}) as hi from v where label >= 0 group by label),
 n as (select label, (select max(label) from v) + row_number() over (order by label) as fresh from s where lo >= 2 and hi >= 2)
 select v.id as entity_id, cast(case when asym >= {ASYMMETRY} and fresh is not null then fresh else v.label end as bigint) as label from v left join n using (label)""",
    "cluster_centroids": f"with {_ITEMS}, {_CENTRES} select label, size, layout, round(asymmetry, 6) as asymmetry, round(x[1], 6) as first, round(list_dot_product(x, x), 6) as squared from c",
    "cluster_merge": f"""with recursive {_ITEMS}, {_CENTRES}, {_reach(f"select a.label as a, b.label as b from c a join c b on a.label < b.label and a.layout = b.layout where list_distance(a.x, b.x) < {MERGE}")},
 r as (select v.id, coalesce(comp.root, v.label) as root from v left join comp on v.label = comp.id where v.label >= 0), f as (select root, dense_rank() over (order by min(id)) - 1 as rank from r group by root)
 select v.id as entity_id, cast(coalesce(f.rank, -1) as bigint) as label from v left join r on v.id = r.id left join f on r.root = f.root""",
    "noise_recover": f"""with {_ITEMS}, {_CENTRES}, d as (select v.id, c.label, list_distance(v.x, c.x) as d from v, c where v.label < 0), b as (select id, arg_min(label, (d, label)) as label, min(d) as d from d group by id)
 select v.id as entity_id, cast(case when b.d < {RECOVER} then b.label else v.label end as bigint) as label from v left join b on v.id = b.id""",
    "noise_pair": f"""with recursive {_ITEMS}, {_NOISE_PAIRS}, {_reach(f"select a, b from p where d < {NOISE_PAIR}")},
 f as (select id, (select max(label) from v) + dense_rank() over (order by root) as fresh from comp) select v.id as entity_id, cast(coalesce(f.fresh, v.label) as bigint) as label from v left join f on v.id = f.id""",
    "noise_diagnostics": f"""with {_ITEMS}, {_NOISE_PAIRS}, s as (select round(d, 4) as d, row_number() over (order by d, a, b) - 1 as i, count(*) over () as n from p)
 select (select count(*) from v where label < 0) as count, max(d) filter (i = 0) as min_dist, max(d) filter (i = n // 4) as p25_dist, max(d) filter (i = n // 2) as median_dist, list_sort(list(d) filter (i < 10)) as top10_smallest from s""",
}
