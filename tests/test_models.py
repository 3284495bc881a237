"""Offline vectors and models: shapes, fallbacks, round trip of a stored model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import medians as Q
from tidemark.operators import models as M
from tidemark.operators import vectors as V


def test_model_round_trip_and_fallbacks(spark, tmp_path):
    rows = [(i, ("fraud default lawsuit" if i % 2 else "sales grew nicely") + f" in unit{chr(97 + i % 7)}", i % 2) for i in range(60)] + [(99, None, 0), (100, "", 0)]
    df = spark.createDataFrame(rows, "id bigint, t string, label int")
    x = M.encoded(df, "id", "t").join(df.select("id", "label"), "id")
    assert x.count() == 61  # a text without words has the zero vector, null none
    parts = M.stratified(x.where("id < 60"), "id", "label")
    held = {(r.label, r.held_out): r["count"] for r in parts.groupBy("label", "held_out").count().collect()}
    assert all(3 <= held[k, True] <= 10 for k in (0, 1))
    model = M.trained(parts.where("not held_out"), 2, 8, rounds=40)
    M.saved(model, str(tmp_path / "model"))
    again = M.loaded(str(tmp_path / "model"))
    a, b = ({r.id: r.boilerplate for r in M.boilerplate_share(parts, "id", m).collect()} for m in (model, again))
    assert a == b and all((a[i] > 0.5) == bool(i % 2) for i in a)
    index = spark.createDataFrame([(1, 0.2)], "id bigint, uniqueness double")
    assert {r.id: (r.boilerplate, r.source) for r in M.boilerplate_share(parts.where("id < 3"), "id", None, index).collect()} == {0: (0.5, "none"), 1: (0.8, "index"), 2: (0.5, "none")}
    assert {r.source for r in M.boilerplate_share(parts, "id").collect()} == {"none"}


def test_sentiment_of_a_model_falls_back_to_the_lexicon(spark):
    lex = spark.createDataFrame([(1, 0.1, 0.2, 0.3), (2, 0.0, 0.0, 0.0)], "id bigint, negative double, positive double, uncertainty double")
    assert M.model_sentiment(None, "id", lex) is lex
    said = spark.createDataFrame([(1, "negative", 0.8), (1, "neutral", 0.9)], "id bigint, label string, confidence double")
    got = {r.id: r for r in M.model_sentiment(None, "id", lex, said).collect()}
    assert got[1].negative == 0.4 and got[1].positive == 0 and got[1].uncertainty == 0.3 and got[2].negative == 0


def test_keyphrases_and_long_texts(spark):
    df = spark.createDataFrame([(1, "supply chain risk and supply chain cost " * 60), (2, ""), (3, None)], "id bigint, t string")
    got = {r.id: r.k for r in df.select("id", M.keyphrases(F.col("t"), 3).alias("k")).collect()}
    assert "supply" in got[1][0].phrase and len({x.phrase for x in got[1]}) == 3 and got[2] == [] and got[3] is None
    long = M.encoded_long(df, "id", "t").collect()
    assert [r.id for r in long] == [1] and len(long[0].vector) == M.DIMS


def test_percentiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 3000)
    df = spark.createDataFrame([("a", float(i * i)) for i in range(4001)] + [("b", 1.0), ("b", 2.0)], "g string, v double")
    got = {r.g: r.x for r in Q.medians(df, ["g"], "v", "x", 0.755).collect()}
    assert abs(got["a"] - 3020.0**2) < 1e-6 and abs(got["b"] - 1.755) < 1e-9


def test_projection_by_neighbours_and_scores(spark):
    known = spark.createDataFrame([(1, [0.0, 0.0], [1.0]), (2, [10.0, 0.0], [5.0])], "id bigint, vector array<double>, point array<double>")
    rows = spark.createDataFrame([(7, [0.0, 0.0]), (8, [5.0, 0.0]), (9, None)], "id bigint, vector array<double>")
    got = {r.id: r.point for r in V.by_neighbours(rows, "id", "vector", known, 2).collect()}
    assert abs(got[7][0] - 1) < 1e-6 and abs(got[8][0] - 3) < 1e-6 and got[9] is None
    paths = spark.createDataFrame([(1, 5, 2, 1, 1), (1, 6, 3, 3, 2)], "company bigint, phrase bigint, peer bigint, lag int, hops int")
    new = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 8)], "company bigint, phrase bigint")
    s = {r.company: r for r in G.contagion_scores(paths, new).collect()}
    assert (s[1].matched, s[1].mean_lag, s[1].bridged, s[1].first_mover) == (2, 2.0, 1, False) and s[2].first_mover
