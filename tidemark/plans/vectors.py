"""Queries on vectors and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import vectors as V
from tidemark.session import stored
from tidemark.sources.tables import table

LEAST = 0.3


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings")


def _nodes(spark: SparkSession, base: str) -> DataFrame:
    return _vectors(spark, base).select(F.col("vec_id").alias("node"))


def _edges(spark: SparkSession, base: str) -> DataFrame:
    """The edges, written once: most measures read them more than once."""
    return stored(V.similar_pairs(_vectors(spark, base), "vec_id", "embedding", LEAST))


def similarity_edges_strict(spark: SparkSession, base: str) -> DataFrame:
    """At the usual limit of 0.5; the other measures take a denser graph at ``LEAST``."""
    return V.similar_pairs(_vectors(spark, base), "vec_id", "embedding", 0.5).select("a", "b", F.round("sim", 6).alias("sim"))


def similarity_edges(spark: SparkSession, base: str) -> DataFrame:
    return _edges(spark, base).select("a", "b", F.round("sim", 6).alias("sim"))


def graph_density(spark: SparkSession, base: str) -> DataFrame:
    return G.density(_nodes(spark, base), _edges(spark, base))


def degree_ego(spark: SparkSession, base: str) -> DataFrame:
    return G.degrees(_edges(spark, base))


def clustering_coeff(spark: SparkSession, base: str) -> DataFrame:
    return G.clustering(_edges(spark, base))


def components(spark: SparkSession, base: str) -> DataFrame:
    return G.components(_nodes(spark, base), _edges(spark, base))


def component_sizes(spark: SparkSession, base: str) -> DataFrame:
    c = components(spark, base).groupBy("component").agg(F.count("*").alias("k"))
    return c.agg(F.count("*").alias("components"), F.max("k").alias("largest"), F.round(F.max("k") / F.sum("k"), 6).alias("largest_share"))


def path_lengths(spark: SparkSession, base: str) -> DataFrame:
    return G.path_lengths(_edges(spark, base))


def centrality_hubs(spark: SparkSession, base: str) -> DataFrame:
    return G.hubs(G.betweenness(_nodes(spark, base), _edges(spark, base)))


def spectral_gap(spark: SparkSession, base: str) -> DataFrame:
    return spark.createDataFrame([(G.spectral_gap(_edges(spark, base)),)], "spectral_gap double")


def communities(spark: SparkSession, base: str) -> DataFrame:
    return G.communities(_nodes(spark, base), _edges(spark, base)).groupBy("community").agg(F.count("*").alias("members"))


def contagion_paths(spark: SparkSession, base: str) -> DataFrame:
    """Labels as companies in a chain, ids as quarters: what the chain's neighbours said before."""
    e = _vectors(spark, base).withColumn("quarter", (F.col("vec_id") % 8).cast("int")).select(F.col("label").cast("bigint").alias("company"), "quarter", F.col("vec_id").alias("phrase"), F.col("embedding").alias("vec"))
    chain = spark.range(9).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("sim"))
    return G.contagion(chain, e, e.where("quarter = 7").drop("quarter"), 7, V.cosine, 0.25)


def _said(spark: SparkSession, base: str) -> DataFrame:
    return _vectors(spark, base).withColumn("quarter", (F.col("vec_id") % 8).cast("int")).select(F.col("label").cast("bigint").alias("company"), "quarter", F.col("vec_id").alias("phrase"), F.col("embedding").alias("vec"))


def contagion_scores(spark: SparkSession, base: str) -> DataFrame:
    return G.contagion_scores(contagion_paths(spark, base), _said(spark, base).where("quarter = 7"))


def ego_view(spark: SparkSession, base: str) -> DataFrame:
    return G.ego(_edges(spark, base))


def mean_path_length(spark: SparkSession, base: str) -> DataFrame:
    return G.mean_path_length(_nodes(spark, base), _edges(spark, base))


def neighbour_projection(spark: SparkSession, base: str) -> DataFrame:
    """Vectors of odd ids projected through their five nearest neighbours among those of even ids, whose points are their first three components."""
    v = _vectors(spark, base)
    known = v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("point"))
    p = V.by_neighbours(v.where("vec_id % 2 = 1"), "vec_id", "embedding", known)
    return p.select("vec_id", *[F.round(F.col("point")[i], 6).alias(f"x{i}") for i in range(3)])


def mean_pool_groups(spark: SparkSession, base: str) -> DataFrame:
    p = V.mean_pool(_vectors(spark, base), "label", "embedding")
    return p.select("label", "n", F.round(F.element_at("pooled", 1), 6).alias("first"), F.round(F.element_at("pooled", -1), 6).alias("last"), F.round(V.norm(F.col("pooled")), 6).alias("length"))


def trajectory_geometry(spark: SparkSession, base: str) -> DataFrame:
    return V.trajectories(_vectors(spark, base), "label", "vec_id", "embedding")


def embedding_blobs(spark: SparkSession, base: str) -> DataFrame:
    """Stored vectors that are missing, cut short or of the wrong size."""
    s = table(spark, base, "sections", "id", "embedding")
    n = F.octet_length("embedding")
    kind = F.when(F.col("embedding").isNull(), "missing").when(n % 4 != 0, "broken").when(n != 1536, "wrong_size").otherwise("whole")
    return s.select(F.col("id").alias("section_id"), kind.alias("kind")).where("kind <> 'whole'")


def pca_projection(spark: SparkSession, base: str) -> DataFrame:
    return V.projected(_vectors(spark, base), "embedding").select("vec_id", *[F.round(F.col("point")[i], 4).alias(f"x{i}") for i in range(3)])


def danger_zones(spark: SparkSession, base: str) -> DataFrame:
    p = V.projected(_vectors(spark, base), "embedding").select("vec_id", "label", "point")
    return V.at_risk(p, "vec_id", V.danger_zones(p, F.col("label") == 3), F.col("label") == 3)


def risk_mlp(spark: SparkSession, base: str) -> DataFrame:
    """Held-out accuracy of a perceptron 64 -> 32 -> 10 on the labels, split by a seeded hash."""
    v = _vectors(spark, base).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(42)), F.lit(5)))
    model = V.classifier(v.where("part > 0"), "embedding", "label", 32, 10)
    test = model.transform(V.as_ml(v.where("part = 0"), "embedding"))
    return test.agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy"))


QUERIES = {
    f.__name__: f
    for f in (similarity_edges, similarity_edges_strict, contagion_scores, ego_view, mean_path_length, neighbour_projection, graph_density, degree_ego, clustering_coeff, components, component_sizes, path_lengths, centrality_hubs, spectral_gap, communities, contagion_paths, mean_pool_groups, trajectory_geometry, embedding_blobs, pca_projection, danger_zones, risk_mlp)
}

_EM = "em AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_ED = f"{_EM}, ed AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM em a JOIN em b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= {LEAST}), bw AS (SELECT a AS u, b AS v, sim FROM ed UNION ALL SELECT b, a, sim FROM ed)"
_RE = f"{_ED}, re AS (SELECT vec_id AS src, vec_id AS node FROM embeddings UNION SELECT src, bw.v FROM re JOIN bw ON bw.u = re.node)"
_LEN = "sqrt(list_sum(list_transform({x}, lambda y: y * y)))"
_TJ = f"t0 AS (SELECT label, vec_id, v, lag(v) OVER w AS pv FROM em WINDOW w AS (PARTITION BY label ORDER BY vec_id)), t1 AS (SELECT label, vec_id, v, CASE WHEN pv IS NOT NULL THEN list_transform(list_zip(v, pv), lambda z: z[1] - z[2]) END AS d FROM t0), t2 AS (SELECT *, {_LEN.format(x='d')} AS l FROM t1), t3 AS (SELECT *, lag(d) OVER w AS pd, lag(l) OVER w AS pl FROM t2 WINDOW w AS (PARTITION BY label ORDER BY vec_id)), t4 AS (SELECT *, CASE WHEN l > 1e-9 AND pl > 1e-9 THEN acos(greatest(-1.0, least(1.0, list_inner_product(d, pd) / (l * pl)))) END AS angle FROM t3)"

_CP = "e AS (SELECT label::BIGINT AS company, (vec_id % 8)::INT AS quarter, vec_id AS phrase, v FROM em), c AS (SELECT a.company, a.phrase, b.company AS peer, 7 - b.quarter AS lag, abs(a.company - b.company)::INT AS hops, row_number() OVER (PARTITION BY a.company, a.phrase ORDER BY 7 - b.quarter, b.company) AS r FROM e a JOIN e b ON abs(a.company - b.company) BETWEEN 1 AND 2 WHERE a.quarter = 7 AND 7 - b.quarter BETWEEN 1 AND 4 AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.25)"

SQL = {
    "similarity_edges_strict": f"WITH {_EM} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM em a JOIN em b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.5",
    "contagion_scores": f"WITH {_EM}, {_CP}, t AS (SELECT company, count(DISTINCT phrase) AS phrases FROM e WHERE quarter = 7 GROUP BY ALL), m AS (SELECT company, count(*) AS matched, avg(lag) AS mean_lag, count_if(hops = 2)::BIGINT AS bridged FROM c WHERE r = 1 GROUP BY ALL) SELECT company, phrases, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / phrases::DOUBLE, 6) AS score, round(mean_lag, 6) AS mean_lag, coalesce(bridged, 0) AS bridged, coalesce(matched, 0) = 0 AS first_mover FROM t LEFT JOIN m USING (company)",
    "ego_view": f"WITH {_ED}, s AS (SELECT u, v, round(sim, 6) AS s FROM bw), d AS (SELECT u, count(*) AS d FROM s GROUP BY u) SELECT u AS node, row_number() OVER (PARTITION BY u ORDER BY s DESC, v)::INT AS rank, v AS neighbour, s AS sim, d >= (SELECT quantile_cont(d::DOUBLE, 0.9) FROM d) AS is_hub FROM s JOIN d USING (u)",
    "mean_path_length": f"WITH RECURSIVE {_RE}, k AS (SELECT src, min(node) AS c FROM re GROUP BY src), n AS (SELECT c, count(*) AS nodes FROM k GROUP BY c ORDER BY nodes DESC, c LIMIT 1), pl AS (SELECT DISTINCT u AS src, u AS node, 0 AS hops FROM bw JOIN k ON k.src = bw.u JOIN n ON n.c = k.c UNION SELECT pl.src, bw.v, hops + 1 FROM pl JOIN bw ON bw.u = pl.node WHERE hops < 30), s AS (SELECT src, node, min(hops) AS hops FROM pl GROUP BY ALL) SELECT c AS component, nodes, (SELECT round(avg(hops), 6) FROM s WHERE hops > 0) AS mean_hops FROM n",
    "neighbour_projection": f"WITH {_EM}, q AS (SELECT a.vec_id, b.v AS p, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM em a JOIN em b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0), w AS (SELECT vec_id, p, 1 / (d + 1e-9::DOUBLE) AS w FROM q WHERE r <= 5) SELECT vec_id, round(sum(p[1] * w) / sum(w), 6) AS x0, round(sum(p[2] * w) / sum(w), 6) AS x1, round(sum(p[3] * w) / sum(w), 6) AS x2 FROM w GROUP BY vec_id",
    "similarity_edges": f"WITH {_ED} SELECT a, b, round(sim, 6) AS sim FROM ed",
    "graph_density": f"WITH {_ED} SELECT (SELECT count(*) FROM embeddings) AS nodes, count(*) AS edges, round(2.0::DOUBLE * count(*) / ((SELECT count(*) FROM embeddings) * ((SELECT count(*) FROM embeddings) - 1)), 9) AS density FROM ed",
    "degree_ego": f"WITH {_ED}, s AS (SELECT u, v, round(sim, 6) AS s FROM bw) SELECT u AS node, count(*) AS degree, max(s) AS strongest, min_by(v, (-s, v)) AS neighbour FROM s GROUP BY u",
    "clustering_coeff": f"WITH {_ED}, w AS (SELECT a, b, sim / (SELECT max(sim) FROM ed) AS w FROM ed), t AS (SELECT x.a AS i, x.b AS j, y.b AS k, pow(x.w * y.w * z.w, 1.0::DOUBLE / 3) AS g FROM w x JOIN w y ON y.a = x.b JOIN w z ON z.a = x.a AND z.b = y.b), p AS (SELECT node, sum(g) AS g FROM (SELECT i AS node, g FROM t UNION ALL SELECT j, g FROM t UNION ALL SELECT k, g FROM t) GROUP BY node), d AS (SELECT u AS node, count(*) AS d FROM bw GROUP BY u) SELECT node, round(coalesce(CASE WHEN d > 1 THEN 2 * g / (d * (d - 1)) END, 0.0), 6) AS coefficient FROM d LEFT JOIN p USING (node)",
    "components": f"WITH RECURSIVE {_RE} SELECT src AS node, min(node) AS component FROM re GROUP BY src",
    "component_sizes": f"WITH RECURSIVE {_RE}, c AS (SELECT src, min(node) AS c FROM re GROUP BY src), k AS (SELECT c, count(*) AS k FROM c GROUP BY c) SELECT count(*) AS components, max(k) AS largest, round(max(k) / sum(k)::DOUBLE, 6) AS largest_share FROM k",
    "path_lengths": f"WITH RECURSIVE {_ED}, pl AS (SELECT DISTINCT u AS src, u AS node, 0 AS hops FROM bw UNION SELECT src, bw.v, hops + 1 FROM pl JOIN bw ON bw.u = pl.node WHERE hops < 30), s AS (SELECT src, node, min(hops) AS hops FROM pl GROUP BY ALL) SELECT hops::INT AS hops, count(*) AS pairs FROM s WHERE hops > 0 GROUP BY hops",
    "contagion_paths": f"WITH {_EM}, e AS (SELECT label::BIGINT AS company, (vec_id % 8)::INT AS quarter, vec_id AS phrase, v FROM em), c AS (SELECT a.company, a.phrase, b.company AS peer, 7 - b.quarter AS lag, abs(a.company - b.company)::INT AS hops, row_number() OVER (PARTITION BY a.company, a.phrase ORDER BY 7 - b.quarter, b.company) AS r FROM e a JOIN e b ON abs(a.company - b.company) BETWEEN 1 AND 2 WHERE a.quarter = 7 AND 7 - b.quarter BETWEEN 1 AND 4 AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.25) SELECT company, phrase, peer, lag, hops FROM c WHERE r = 1",
    "mean_pool_groups": f"WITH {_EM}, p AS (SELECT label, i, count(*) AS n, avg(v[i]) AS x FROM em, range(1, 65) r(i) GROUP BY ALL) SELECT label, max(n) AS n, round(max(CASE WHEN i = 1 THEN x END), 6) AS first, round(max(CASE WHEN i = 64 THEN x END), 6) AS last, round(sqrt(sum(x * x)), 6) AS length FROM p GROUP BY label",
    "trajectory_geometry": f"WITH {_EM}, {_TJ}, t5 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM t4), g AS (SELECT label, count(*) AS points, max(CASE WHEN r = 1 THEN l END) AS l1, max(CASE WHEN r = 3 THEN l END) AS l3, sum(l) AS length, avg(angle) AS turning, min_by(v, vec_id) AS f, max_by(v, vec_id) AS t FROM t5 GROUP BY label HAVING count(*) >= 3) SELECT label, points, round(length, 6) AS length, round(length / (points - 1), 6) AS speed, round(coalesce(turning, 0.0), 6) AS turning, round({_LEN.format(x='list_transform(list_zip(t, f), lambda z: z[1] - z[2])')}, 6) AS net, round(CASE WHEN points >= 4 THEN (l1 - l3) / 2 ELSE 0.0 END, 6) AS acceleration, round((t[1] - f[1]) / {_LEN.format(x='list_transform(list_zip(t, f), lambda z: z[1] - z[2])')}, 6) AS direction_0 FROM g",
    "embedding_blobs": "WITH k AS (SELECT id AS section_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN octet_length(embedding) % 4 <> 0 THEN 'broken' WHEN octet_length(embedding) <> 1536 THEN 'wrong_size' ELSE 'whole' END AS kind FROM sections) SELECT * FROM k WHERE kind <> 'whole'",
}
