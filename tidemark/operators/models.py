"""Offline text vectors and the models on them: risk and boilerplate classifiers, keyphrases by marginal relevance.

Vectors are hashed bags of words, so nothing is downloaded; an encoder of
another kind can be put in wherever a (key, vector) table is taken.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.lexical import chunk_windows

DIMS = 384
# Scores of the risk levels and the order of their labels.
LEVEL_SCORES = {"low": 0.10, "medium": 0.45, "high": 0.75, "critical": 0.95}
LEVELS = list(LEVEL_SCORES)


def encoded(rows: DataFrame, key: str, text: str, dims: int = DIMS) -> DataFrame:
    """(key, features) of each text that is not null: counts of hashed words, of length 1; a text without words has the zero vector."""
    words = rows.where(F.col(text).isNotNull()).select(key, T.tokens(F.col(text)).alias("w_"))
    tf = HashingTF(numFeatures=dims, inputCol="w_", outputCol="tf_").transform(words)
    return Normalizer(inputCol="tf_", outputCol="features").transform(tf).select(key, "features")


def encoded_long(rows: DataFrame, key: str, text: str, size: int = 2000, overlap: int = 400) -> DataFrame:
    """(key, vector) of long texts: the mean of the vectors of their windows; blank texts have no row."""
    step = size - overlap
    pieces = rows.join(chunk_windows(rows, key, text, size, overlap), key).select(key, "chunk", F.substring(F.col(text), F.col("chunk") * step + 1, F.lit(size)).alias("piece"))
    parts = encoded(pieces.withColumn("at_", F.struct(key, "chunk")), "at_", "piece")
    long = parts.select(F.col(f"at_.{key}").alias(key), F.posexplode(vector_to_array("features")).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector"))


def stratified(rows: DataFrame, key: str, label: str, share: float = 0.2) -> DataFrame:
    """The rows with ``held_out``: of each label the first ``share`` in the order of a seeded hash, the same in every run."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(42)), F.lit(1_000_000)) / 1_000_000
    cut = rows.withColumn("h_", h).groupBy(label).agg(F.percentile_approx("h_", share, 100_000).alias("cut_"))
    return rows.withColumn("h_", h).join(F.broadcast(cut), label).withColumn("held_out", F.col("h_") <= F.col("cut_")).drop("h_", "cut_")  # a row for each label


def trained(rows: DataFrame, classes: int, hidden: int = 128, dims: int = DIMS, rounds: int = 60) -> MultilayerPerceptronClassificationModel:
    """A perceptron dims -> hidden -> classes from (features, label)."""
    given = rows.select("features", F.col("label").cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[dims, hidden, classes], seed=42, maxIter=rounds).fit(given)


def saved(model: MultilayerPerceptronClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def loaded(path: str) -> MultilayerPerceptronClassificationModel:
    return MultilayerPerceptronClassificationModel.load(path)


def classified_risk(model: MultilayerPerceptronClassificationModel, rows: DataFrame, key: str) -> DataFrame:
    """(key, level, confidence, score): the likeliest level and its score times the confidence in it."""
    p = model.transform(rows).withColumn("p_", vector_to_array("probability"))
    sure = F.array_max("p_")
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("prediction") + 1).cast("int"))
    score = F.element_at(F.array(*[F.lit(x) for x in LEVEL_SCORES.values()]), (F.col("prediction") + 1).cast("int"))
    return p.select(key, level.alias("level"), F.round(sure, 6).alias("confidence"), F.round(score * sure, 6).alias("score"))


def boilerplate_share(rows: DataFrame, key: str, model: MultilayerPerceptronClassificationModel | None = None, index: DataFrame | None = None) -> DataFrame:
    """(key, boilerplate, source): how surely a sentence is boilerplate, by the model, else by the index of uniqueness (key, uniqueness), else 0.5."""
    if model is not None:
        p = model.transform(rows)
        return p.select(key, F.round(vector_to_array("probability")[1], 6).alias("boilerplate"), F.lit("model").alias("source"))
    if index is not None:
        j = rows.select(key).join(index, key, "left")
        return j.select(key, F.coalesce(1 - F.col("uniqueness"), F.lit(0.5)).alias("boilerplate"), F.when(F.col("uniqueness").isNull(), "none").otherwise("index").alias("source"))
    return rows.select(key, F.lit(0.5).alias("boilerplate"), F.lit("none").alias("source"))


def model_sentiment(sentences: DataFrame, key: str, lexical: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Sentiment of each text: positive and negative as the mean confidence of a model's sentence labels (key, label, confidence), the rest from the lexicon; without a model all from the lexicon."""
    if labelled is None:
        return lexical
    side = lambda name: F.avg(F.when(F.col("label") == name, F.col("confidence")).otherwise(0.0)).alias(name)
    g = labelled.groupBy(key).agg(side("positive"), side("negative"))
    return lexical.drop("positive", "negative").join(g, key, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("positive", "negative")})


def keyphrases(text: Column, k: int = 10, diversity: float = 0.5, dims: int = DIMS) -> Column:
    """The ``k`` phrases of two or three words that are most like their text and least like each other (maximal marginal relevance), as (phrase, score)."""

    @F.pandas_udf("array<struct<phrase:string,score:double>>")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: _marginal(list(w), k, diversity, dims) if w is not None else None)

    return run(T.content_tokens(text))


def _marginal(words: list[str], k: int, diversity: float, dims: int) -> list[dict]:
    phrases = sorted({" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)})
    if not phrases:
        return []
    slot = {w: zlib.crc32(w.encode()) % dims for w in set(words)}
    whole = np.bincount([slot[w] for w in words], minlength=dims).astype(float)
    x = np.zeros((len(phrases), dims))
    for i, p in enumerate(phrases):
        for w in p.split():
            x[i, slot[w]] += 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    like = x @ whole / np.linalg.norm(whole)
    chosen = [int(like.argmax())]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(k, len(phrases)):
        value = (1 - diversity) * like - diversity * nearest
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return [{"phrase": phrases[i], "score": round(float(like[i]), 4)} for i in chosen]

