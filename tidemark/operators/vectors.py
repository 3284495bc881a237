"""Vector operators: cosine, exact similar pairs in blocks, pooling, projection, trajectories, zones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def similar_pairs(rows: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(a, b, sim) of all pairs a < b whose cosine is ``least`` or more, exactly.

    Rows are dealt to blocks of about ``BLOCK``; each pair of blocks is compared
    by one task with a matrix product, so no task holds more than two blocks.
    The work is quadratic: it is meant for the vectors of companies, not of
    documents. Null vectors and those of another size than the first are left out.
    """
    given = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = given.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = given.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def compare(t: pa.Table) -> pa.Table:
        ids, block = t["id"].to_numpy(), t["block"].to_numpy()
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        vecs = t["v"].to_pylist()
        size = max((len(v) for v in vecs), default=0)
        ok = np.array([len(v) == size for v in vecs])
        x = np.array([v for v, k in zip(vecs, ok) if k], float).reshape(-1, size)
        ids, block = ids[ok], block[ok]
        length = np.sqrt((x * x).sum(1))
        x = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        sim = x[left] @ x[right].T
        i, j = np.nonzero(sim >= least - 1e-9)
        s, a, b = sim[i, j], ids[left[i]], ids[right[j]]
        keep = a < b if lo == hi else a != b
        return pa.table({"a": pa.array(np.minimum(a, b)[keep]), "b": pa.array(np.maximum(a, b)[keep]), "sim": pa.array(s[keep])})

    return dealt.groupBy("lo", "hi").applyInArrow(compare, "a bigint, b bigint, sim double").where(F.round("sim", 9) >= least)


def mean_pool(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, pooled): the mean vector of each group, combined before the shuffle."""
    parts = rows.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("pooled"))


def trajectories(rows: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """Length, speed, mean turning angle, net distance, slope of the last three speeds and first part of the direction of each group's path, for paths of three points or more.

    The slope is 0 with fewer than three steps; the direction is the net way divided by its length.
    """
    w = Window.partitionBy(group).orderBy(order)
    steps = rows.withColumn("v_", F.col(vector).cast("array<double>")).withColumn("d_", minus(F.col("v_"), F.lag("v_").over(w))).withColumn("l_", norm(F.col("d_"))).withColumn("r_", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order))))
    turned = steps.withColumn("p_", F.lag("d_").over(w)).withColumn("pl_", F.lag("l_").over(w))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("d_"), F.col("p_")) / (F.col("l_") * F.col("pl_")))))
    turned = turned.withColumn("angle", F.when((F.col("l_") > 1e-9) & (F.col("pl_") > 1e-9), angle))
    g = turned.groupBy(group).agg(F.count("*").alias("points"), F.sum("l_").alias("length"), F.avg("angle").alias("turning"), F.min_by("v_", order).alias("first"), F.max_by("v_", order).alias("last"), *[F.max(F.when(F.col("r_") == k, F.col("l_"))).alias(f"l{k}_") for k in (1, 3)]).where("points >= 3")
    net = norm(minus(F.col("last"), F.col("first")))
    slope = F.when(F.col("points") >= 4, (F.col("l1_") - F.col("l3_")) / 2).otherwise(0.0)
    way = F.when(net > 1e-9, minus(F.col("last"), F.col("first"))[0] / net).otherwise(0.0)
    return g.select(group, "points", F.round("length", 6).alias("length"), F.round(F.col("length") / (F.col("points") - 1), 6).alias("speed"), F.round(F.coalesce("turning", F.lit(0.0)), 6).alias("turning"), F.round(net, 6).alias("net"), F.round(slope, 6).alias("acceleration"), F.round(way, 6).alias("direction_0"))


def as_ml(rows: DataFrame, vector: str, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn(out, array_to_vector(F.col(vector).cast("array<double>")))


def projected(rows: DataFrame, vector: str, k: int = 3) -> DataFrame:
    """Principal components of the centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    m = as_ml(rows, vector)
    centred = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(m).transform(m)
    return PCA(k=k, inputCol="centred", outputCol="point").fit(centred).transform(centred).withColumn("point", vector_to_array("point")).drop("features", "centred")


def danger_zones(points: DataFrame, distressed: Column, seed: int = 42) -> DataFrame:
    """Clusters of distressed points as (zone, centre, radius, members); five points at least.

    k is the root of their number, five at most, so zones and centres are few.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array

    bad = points.where(distressed)
    n = bad.count()
    if n < 5:
        return points.sparkSession.createDataFrame([], "zone int, centre array<double>, radius double, members bigint")
    m = as_ml(bad, "point")
    model = KMeans(k=max(1, min(5, int(n**0.5))), seed=seed, featuresCol="features", predictionCol="zone").fit(m)
    centres = points.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "zone int, centre array<double>")
    near = model.transform(m).join(F.broadcast(centres), "zone").withColumn("away", norm(minus(vector_to_array("features"), F.col("centre"))))  # five centres at most
    return near.groupBy("zone", "centre").agg(F.avg("away").alias("radius"), F.count("*").alias("members"))


def at_risk(points: DataFrame, key: str, zones: DataFrame, distressed: Column) -> DataFrame:
    """(key, zone, proximity, log_density) of points within two radii of a zone's centre that lie as densely as the zone's own.

    The density is that of Gaussians of width max(0.5 radius, 0.1) on the zone's
    distressed points; a point must reach the 20th percentile of theirs.
    """
    away = norm(minus(F.col("point"), F.col("centre")))
    near = points.join(F.broadcast(zones), away < 2 * F.col("radius")).withColumn("away", away)  # five zones at most
    closest = Window.partitionBy(key).orderBy(away)
    home = points.where(distressed).join(F.broadcast(zones), F.lit(True)).withColumn("r_", F.row_number().over(closest)).where("r_ = 1").select("zone", F.col(key).alias("member"), F.col("point").alias("at"), "radius")  # each in its nearest zone
    wide = F.greatest(0.5 * F.col("radius"), F.lit(0.1))
    size = home.groupBy("zone").agg(F.count("*").alias("k"))

    def density(rows: DataFrame) -> DataFrame:
        """Logarithm of the mean kernel, summed up around its largest part."""
        e = rows.select("zone", key, "point").join(home, "zone").withColumn("e", -(dot(minus(F.col("point"), F.col("at")), minus(F.col("point"), F.col("at")))) / (2 * wide * wide)).withColumn("w", wide)
        top = e.groupBy("zone", key).agg(F.max("e").alias("top"))
        s = e.join(top, ["zone", key]).groupBy("zone", key).agg(F.sum(F.exp(F.col("e") - F.col("top"))).alias("s"), F.first("top").alias("top"), F.first("w").alias("w"), F.first(F.size("at")).alias("d")).join(F.broadcast(size), "zone")
        return s.select("zone", key, (F.col("top") + F.log("s") - F.log("k") - F.col("d") * F.log(F.col("w") * (2 * math.pi) ** 0.5)).alias("log_density"))

    own = density(home.select("zone", F.col("member").alias(key), F.col("at").alias("point")))
    limit = own.groupBy("zone").agg(F.percentile("log_density", F.lit(0.2)).alias("least"))
    j = near.join(density(near), ["zone", key]).join(F.broadcast(limit), "zone").where("log_density >= least")  # five rows at most
    return j.select(key, "zone", F.round(1 - F.col("away") / (2 * F.col("radius")), 6).alias("proximity"), F.round("log_density", 6).alias("log_density"))


#: Reference points that projection by neighbours may hold in each task.
MOST_POINTS = 200_000


def by_neighbours(rows: DataFrame, key: str, vector: str, known: DataFrame, k: int = 5) -> DataFrame:
    """(key, point): the mean of the points of the ``k`` nearest known vectors, weighted by inverse distance.

    ``known`` has (id, vector, point); it is a fitted space of bounded size, which is checked.
    """
    held = known.limit(MOST_POINTS + 1).collect()
    if len(held) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} known points")
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r["vector"] for r in held], float), np.array([r["point"] for r in held], float)))

    @F.pandas_udf("array<double>")
    def run(vs: pd.Series) -> pd.Series:
        x, p = shared.value
        out = []
        for v in vs:
            if v is None or not len(x):
                out.append(None)
                continue
            d = np.sqrt(((x - np.asarray(v, float)) ** 2).sum(1))
            at = np.argsort(d, kind="stable")[:k]
            w = 1 / (d[at] + 1e-9)
            out.append((p[at] * (w / w.sum())[:, None]).sum(0))
        return pd.Series(out)

    return rows.select(key, run(F.col(vector).cast("array<double>")).alias("point"))


def classifier(train: DataFrame, features: str, label: str, hidden: int, classes: int, seed: int = 42):
    """A multilayer perceptron features -> hidden -> classes."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    m = as_ml(train, features).withColumn("label", F.col(label).cast("double"))
    size = len(m.select(features).first()[0])
    return MultilayerPerceptronClassifier(layers=[size, hidden, classes], seed=seed, maxIter=60, featuresCol="features", labelCol="label").fit(m)
