"""Identities: nearest vectors, votes, centroids and merges of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.graphs import components
from tracewright.operators.vectors import centroids, cosine_distance, doubles, kept_within_margin, knn, normalized, top_k, vote
from tracewright.registry import query
from tracewright.sources.driver_tables import VECTORS_SQL, vectors

K, FAR, LINKS = 5, 0.62, 2
_D = "1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
_KNN = f"""{VECTORS_SQL}, pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.identity AS ia, b.identity AS ib, {_D} AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
kn AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM pairs QUALIFY k <= {K})"""


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first vector asks."""
    return list(vectors(spark, sf_dir).orderBy("vec_id").first()["embedding"])


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", "identity", normalized(doubles(F.col("embedding"))).alias("unit"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir)
    found = knn(u.select(F.col("vec_id").alias("a"), F.col("unit").alias("x")), u.select(F.col("vec_id").alias("b"), F.col("unit").alias("y")), K)
    return found.join(u.select(F.col("vec_id").alias("a"), F.col("identity").alias("ia")), "a").join(u.select(F.col("vec_id").alias("b"), F.col("identity").alias("ib")), "b")


@query("vector_top_k", f"WITH {VECTORS_SQL}, q AS (SELECT embedding FROM v ORDER BY vec_id LIMIT 1) SELECT a.vec_id, round({_D}, 6) AS distance FROM v a, q b ORDER BY {_D}, vec_id LIMIT 20")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(vectors(spark, sf_dir), _query(spark, sf_dir), "embedding", "vec_id", 20).select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    "vector_top_k_pruned",
    f"""WITH {VECTORS_SQL}, q AS (SELECT embedding FROM v ORDER BY vec_id LIMIT 1), d AS (SELECT a.vec_id, {_D} AS x FROM v a, q b WHERE a.vec_id > (SELECT min(vec_id) FROM v)), k AS (SELECT * FROM d WHERE x <= 0.9 ORDER BY x, vec_id LIMIT 50)
SELECT vec_id, round(x, 6) AS distance FROM k WHERE x <= (SELECT min(x) FROM k) + 0.1""",
)
def vector_top_k_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within an absolute threshold and a margin from the nearest; who asks is left out."""
    v = vectors(spark, sf_dir)
    first = v.agg(F.min("vec_id").alias("first"))
    near = top_k(v.join(F.broadcast(first), F.col("vec_id") > F.col("first")), _query(spark, sf_dir), "embedding", "vec_id", 50, 0.9)
    return kept_within_margin(near, 0.1).select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    "vector_top_k_distinct",
    f"""WITH {VECTORS_SQL}, q AS (SELECT embedding FROM v ORDER BY vec_id LIMIT 1), d AS (SELECT a.vec_id, a.identity, {_D} AS x FROM v a, q b),
r AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY x, vec_id) AS k FROM d) SELECT identity, vec_id, round(x, 6) AS distance FROM r WHERE k = 1 ORDER BY x, vec_id LIMIT 8""",
)
def vector_top_k_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vector of each identity, the eight nearest identities; those of no one are one group."""
    q = F.array(*(F.lit(float(x)) for x in _query(spark, sf_dir)))
    d = vectors(spark, sf_dir).withColumn("x", cosine_distance(doubles(F.col("embedding")), q))
    best = d.withColumn("k", F.row_number().over(W.partitionBy("identity").orderBy("x", "vec_id"))).where("k = 1")
    return best.orderBy("x", "vec_id").limit(8).select("identity", "vec_id", F.round("x", 6).alias("distance"))


@query("knn_self_join", f"WITH {_KNN} SELECT a, b, k, round(d, 6) AS distance FROM kn")
def knn_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("a", "b", F.col("k").cast("long").alias("k"), F.round("distance", 6).alias("distance"))


@query(
    "identity_edges",
    f"WITH {_KNN} SELECT least(ia, ib) AS a, greatest(ia, ib) AS b, count(*) AS links, round(min(d), 6) AS distance FROM kn WHERE ia <> ib AND d <= {FAR} GROUP BY ALL HAVING count(*) >= {LINKS}",
)
def identity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of identities with enough near neighbours of each other."""
    near = _neighbours(spark, sf_dir).where((F.col("ia") != F.col("ib")) & (F.col("distance") <= FAR))
    return near.groupBy(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).agg(F.count(F.lit(1)).alias("links"), F.round(F.min("distance"), 6).alias("distance")).where(F.col("links") >= LINKS)


@query(
    "unattributed_edges",
    f"WITH {_KNN} SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS links, round(min(d), 6) AS distance FROM kn WHERE ia IS NULL AND ib IS NULL GROUP BY 1, 2",
)
def unattributed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _neighbours(spark, sf_dir).where("ia is null and ib is null")
    return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("links"), F.round(F.min("distance"), 6).alias("distance"))


@query("knn_agreement", f"WITH {_KNN} SELECT a AS vec_id, min(ib) AS identity, count(*) AS agree FROM kn WHERE ia IS NULL AND ib IS NOT NULL AND d <= {FAR} GROUP BY a HAVING count(*) >= 2 AND min(ib) = max(ib)")
def knn_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unattributed vectors that at least two near neighbours, and all of them, give to the same identity."""
    near = _neighbours(spark, sf_dir).where((F.col("distance") <= FAR) & F.col("ia").isNull() & F.col("ib").isNotNull())
    return near.groupBy(F.col("a").alias("vec_id")).agg(F.min("ib").alias("identity"), F.max("ib").alias("other"), F.count(F.lit(1)).alias("agree")).where("agree >= 2 and identity = other").drop("other")


@query(
    "knn_vote",
    f"""WITH {_KNN}, c AS (SELECT a, ib, count(*) AS votes, min(d) AS best FROM kn WHERE ib IS NOT NULL GROUP BY a, ib),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(votes) OVER w, 0) AS nx, sum(votes) OVER (PARTITION BY a) AS al FROM c WINDOW w AS (PARTITION BY a ORDER BY votes DESC, best, ib))
SELECT a AS vec_id, CASE WHEN votes >= 0.6 * al OR (votes >= ceil(al / 3) AND best <= {FAR} AND votes - nx >= 2) THEN ib END AS winner, votes, CAST(al AS BIGINT) AS asked FROM r WHERE k = 1""",
)
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote(_neighbours(spark, sf_dir).withColumnRenamed("ib", "identity"), FAR).withColumnRenamed("a", "vec_id")


_CENTROIDS = f"""{VECTORS_SQL}, e AS (SELECT identity, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM v WHERE identity IS NOT NULL),
m AS (SELECT identity, i, avg(x) AS x, count(*) AS n FROM e GROUP BY identity, i), cn AS (SELECT identity, max(n) AS n, list(x ORDER BY i) AS mean, sqrt(sum(x * x)) AS len FROM m GROUP BY identity)"""


@query("identity_centroids", f"WITH {_CENTROIDS} SELECT identity, n, round(mean[1] / len, 6) AS first, round(mean[64] / len, 6) AS last FROM cn")
def identity_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = centroids(vectors(spark, sf_dir).where("identity is not null"), "identity", "embedding")
    return c.select("identity", "n", F.round(F.element_at("centroid", 1), 6).alias("first"), F.round(F.element_at("centroid", 64), 6).alias("last"))


@query(
    "centroid_links",
    f"WITH {_CENTROIDS} SELECT a.identity AS a, b.identity AS b, round(1 - list_dot_product(a.mean, b.mean) / (a.len * b.len), 6) AS distance FROM cn a JOIN cn b ON a.identity < b.identity WHERE 1 - list_dot_product(a.mean, b.mean) / (a.len * b.len) <= 1.0",
)
def centroid_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of identities whose centroids are at most 1 apart; the catalogue of identities is small."""
    c = centroids(vectors(spark, sf_dir).where("identity is not null"), "identity", "embedding")
    a, b = c.select(F.col("identity").alias("a"), F.col("centroid").alias("x")), c.select(F.col("identity").alias("b"), F.col("centroid").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).withColumn("distance", cosine_distance(F.col("x"), F.col("y"))).where("distance <= 1.0").select("a", "b", F.round("distance", 6).alias("distance"))


@query("recluster")
def recluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-linkage clusters of identities over their edges, with the loosest edge in each."""
    edges = identity_edges(spark, sf_dir).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "distance")
    found = components(edges)
    loosest = edges.join(found.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.max("distance").alias("loosest"))
    return found.join(loosest, "component").select(F.col("id").alias("identity"), F.col("component").alias("cluster"), "loosest")
