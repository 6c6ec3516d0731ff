"""Queries over embeddings: clusters, layout and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import cluster as cl
from quillgrid.operators import index as ix
from quillgrid.operators.search import top_k
from quillgrid.plans import views as v
from quillgrid.plans.views import with_views
from quillgrid.session import scratch_path
from quillgrid.sources.files import embed

EPS, MIN_SIZE = 0.2, 4


def density_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cl.density_clusters(v.points(spark, folder), EPS, MIN_SIZE)


def _components_sql(close: str, k: int) -> str:
    """CTEs from the pairs ``near(id, other)`` to ``clustered(id, cluster)`` of the core points."""
    return f""",
near as materialized ({close}),
core as materialized (select id from near group by id having count(*) >= {k}),
links as materialized (select id, other from near where id in (from core) and other in (from core)),
reach(id, other) as (select id, id from core union select r.id, l.other from reach r join links l on l.id = r.other),
roots as (select id, min(other) root from reach group by id),
clustered as (select id, root cluster from roots where root in (select root from roots group by root having count(*) >= {k}))"""


DENSITY_CLUSTERS_SQL = with_views("fx_points", "", recursive=True).rstrip() + _components_sql(
    f"""select a.id, b.id other from fx_points a join fx_points b on b.px between a.px - {EPS} and a.px + {EPS}
  and (a.px - b.px) ** 2 + (a.py - b.py) ** 2 <= {EPS} * {EPS}""", MIN_SIZE) + """
select id, coalesce(cluster, -1) cluster from fx_points p left join clustered c using (id)"""



def density_clusters_full(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of the whole embeddings, at the eps that the distances to the fourth closest vectors suggest."""
    vectors = v.table(spark, folder, "embeddings")
    eps = round(cl.suggested_eps(vectors, MIN_SIZE, id_col="vec_id", vector_col="embedding"), 6)
    return cl.density_clusters(vectors, eps, MIN_SIZE, id_col="vec_id", vector_col="embedding")


DENSITY_CLUSTERS_FULL_SQL = f"""with recursive e as materialized (select vec_id id, embedding::double[] v from embeddings where embedding is not null),
q as (select * from e order by md5(id::varchar), id limit {cl.SAMPLED}),
pairs as materialized (select a.id, b.id other, list_distance(a.v, b.v) d from e a, e b),
ranked as (select id, d, row_number() over (partition by id order by d) n from pairs where id in (select id from q)),
chosen as materialized (select round(quantile_cont(d, {cl.CORE_SHARE}), 6) eps from ranked where n = {MIN_SIZE} and d > 0)""" + _components_sql(
    "select id, other from pairs, chosen where d <= eps", MIN_SIZE) + """
select vec_id id, coalesce(cluster, -1) cluster from embeddings left join clustered on id = vec_id"""

LETTERS = "aeionrst"
DOC_EPS, DOC_MIN_SIZE = 0.005, 3


def letter_model():
    """A stand-in for a user's embedding model: shares of eight letters in the whole text, NaN if it is empty."""
    import numpy as np

    def predict(texts):
        return np.array([[t.count(c) / len(t) if t else np.nan for c in LETTERS] for t in texts], dtype="float32")

    return predict


def document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    docs = v.table(spark, folder, "documents").select("doc_id", "text")
    return embed(docs, letter_model, input_col="text").drop("text")


def cluster_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job: embed, cluster, lay out. Coordinates have no SQL twin, so only their presence is shown."""
    docs = document_vectors(spark, folder).withColumn("file", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    clusters = cl.cluster_documents(docs, DOC_EPS, DOC_MIN_SIZE)
    return clusters.select("file", "cluster", (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("placed"))


_LETTERS_SQL = ", ".join(f"((length(text) - length(replace(text, '{c}', ''))) / length(text))::float::double" for c in LETTERS)
CLUSTER_DOCUMENTS_SQL = f"with recursive vecs as materialized (select doc_id id, [{_LETTERS_SQL}] vec from documents)" + _components_sql(
    f"""select a.id, b.id other from vecs a join vecs b on b.vec[1] between a.vec[1] - {DOC_EPS} and a.vec[1] + {DOC_EPS}
  and list_distance(a.vec, b.vec) <= {DOC_EPS}""", DOC_MIN_SIZE) + """
select concat('doc/', id) file, coalesce(cluster, -1) cluster, true placed from vecs left join clustered using (id)"""


def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    vectors = document_vectors(spark, folder)
    return vectors.select("doc_id", *[F.col("embedding")[i].alias(f"share_{c}") for i, c in enumerate(LETTERS)])


EMBED_DOCUMENTS_SQL = "select doc_id, " + ", ".join(
    f"((length(text) - length(replace(text, '{c}', ''))) / length(text))::float share_{c}" for c in LETTERS
) + " from documents"


def layout_2d(spark: SparkSession, folder: str) -> DataFrame:
    return cl.layout_2d(v.table(spark, folder, "embeddings"), "vec_id", "embedding")


def layout_plane(spark: SparkSession, folder: str) -> DataFrame:
    """The layout of vectors with two elements, whose principal axes have a closed form."""
    placed = cl.layout_2d(v.points(spark, folder))
    return placed.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


LAYOUT_PLANE_SQL = with_views("fx_points", """, moments as (select var_samp(px) a, covar_samp(px, py) b, var_samp(py) c from fx_points),
axis as (select cos(atan2(2 * b, a - c) / 2) u, sin(atan2(2 * b, a - c) / 2) w from moments),
axes as (select case when abs(u) >= abs(w) then sign(u) else sign(w) end s, case when abs(w) >= abs(u) then sign(-w) else sign(u) end t, u, w from axis)
select id, round(s * (px * u + py * w), 6) x, round(t * (py * u - px * w), 6) y from fx_points, axes""")


def neighbour_distances(spark: SparkSession, folder: str) -> DataFrame:
    """How far the fourth closest vector is from sampled ones: the numbers that eps is chosen from."""
    found = cl.neighbour_distances(v.table(spark, folder, "embeddings"), MIN_SIZE, id_col="vec_id", vector_col="embedding")
    return found.select("id", F.round("distance", 6).alias("distance"))


NEIGHBOUR_DISTANCES_SQL = f"""with e as materialized (select vec_id, embedding::double[] v from embeddings where embedding is not null),
q as (select * from e order by md5(vec_id::varchar), vec_id limit {cl.SAMPLED}),
ranked as (select q.vec_id id, list_distance(q.v, e.v) d, row_number() over (partition by q.vec_id order by list_distance(q.v, e.v)) n from q, e)
select id, round(d, 6) distance from ranked where n = {MIN_SIZE}"""


def semantic_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 vectors closest to vector 0 among those with a positive label."""
    vectors = v.table(spark, folder, "embeddings")
    query = vectors.filter("vec_id = 0").select("embedding").first()[0]
    found = top_k(vectors, query, 100, id_col="vec_id", where=F.col("label") > 0)
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


SEMANTIC_TOPK_SQL = """select vec_id, "label", round(score, 6) score from (
 select e.vec_id, e."label", list_dot_product(e.embedding::double[], q.embedding::double[])
  / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]) * list_dot_product(q.embedding::double[], q.embedding::double[])) score
 from embeddings e, (select embedding from embeddings where vec_id = 0) q where e."label" > 0)
order by score desc, vec_id limit 100"""


def semantic_index(spark: SparkSession, folder: str) -> DataFrame:
    """A stored index of all embeddings, and the ten rows most similar to every twentieth one, at a recall of 0.95 on sampled queries."""
    vectors = v.table(spark, folder, "embeddings")
    model = ix.fit(vectors, id_col="vec_id")
    path = scratch_path(spark, "semantic-index")
    ix.add(vectors, path, model, id_col="vec_id")
    probes = ix.probes_for(spark, path, model, 0.95)
    found = ix.search(spark, path, model, vectors.filter("vec_id % 20 = 0"), 10, probes, id_col="vec_id")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "label", "score")


QUERIES = {
    "density_clusters": density_clusters,
    "density_clusters_full": density_clusters_full,
    "cluster_documents": cluster_documents,
    "embed_documents": embed_documents,
    "layout_2d": layout_2d,
    "layout_plane": layout_plane,
    "neighbour_distances": neighbour_distances,
    "semantic_topk": semantic_topk,
    "semantic_index": semantic_index,
}
ORACLES = {
    "density_clusters": DENSITY_CLUSTERS_SQL,
    "density_clusters_full": DENSITY_CLUSTERS_FULL_SQL,
    "cluster_documents": CLUSTER_DOCUMENTS_SQL,
    "embed_documents": EMBED_DOCUMENTS_SQL,
    "layout_plane": LAYOUT_PLANE_SQL,
    "neighbour_distances": NEIGHBOUR_DISTANCES_SQL,
    "semantic_topk": SEMANTIC_TOPK_SQL,
}
