"""Nearest vectors: recall against brute force, ties, malformed vectors."""

from __future__ import annotations

import numpy as np

from tidemark.llm import neighbours as N


def _table(spark, vecs):
    return spark.createDataFrame([(i, v, 0) for i, v in vecs], "id bigint, blob binary, home int")


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 50)
    monkeypatch.setattr(N, "_HELD", 700)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    x = (centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 64))).astype("<f4")
    rows = [(i, v.tobytes()) for i, v in enumerate(x)] + [(9000, None), (9001, b"abc"), (9002, b"\0" * 256), (9003, np.full(64, np.nan, "<f4").tobytes()), (None, x[0].tobytes()), (5, x[5].tobytes())]
    got: dict[int, set] = {}
    for r in N.nearest(_table(spark, rows), "id", "blob", 10, 64).collect():
        got.setdefault(r.id, set()).add(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(float) @ u.T.astype(float)
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :10]
    assert set(got) == set(range(1500)) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[i] & set(want[i].tolist())) / 10 for i in range(1500)]) >= 0.9


def test_ties_go_to_the_smaller_id(spark):
    v = np.zeros(64, "<f4")
    v[0] = 2
    w = v.copy()
    w[1] = 1
    rows = [(i, v.tobytes()) for i in range(6)] + [(6, w.tobytes())]
    got = {(r.id, r.other): r.rank for r in N.nearest(_table(spark, rows), "id", "blob", 3, 64).collect()}
    assert {o for i, o in got if i == 6} == {0, 1, 2} and {o for i, o in got if i == 0} == {1, 2, 3}


def test_few_and_none(spark):
    v = np.ones(64, "<f4").tobytes()
    assert N.nearest(_table(spark, [(1, v), (2, v)]), "id", "blob", 10, 64).count() == 2
    assert N.nearest(_table(spark, [(1, None)]), "id", "blob", 10, 64).count() == 0


def test_codes_keep_inner_products():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = N.Quantiser(x, 4)
    home = (x @ q.centroids.T).argmax(1)

    def decoded(packed):
        codes = np.empty((len(packed), q.pairs), np.uint8)
        codes[:, 0::2], codes[:, 1::2] = packed & 15, packed >> 4
        return q.book[np.arange(q.pairs), codes].reshape(len(packed), -1) + q.centroids[home]

    packed = q.encode(x, home)
    back = decoded(packed)
    found = q.scores(x[:50], packed, home)
    assert np.abs(found - x[:50] @ back.T).max() < 2e-3  # the table gives the sums of the quantised vectors
    assert np.corrcoef((x[:50] @ x.T).ravel(), found.ravel())[0, 1] > 0.9
    q.eta = 1.0
    plain = decoded(q.encode(x, home))
    along = [np.abs(((b - x) * x).sum(1)).mean() for b in (back, plain)]
    assert along[0] < 0.5 * along[1]  # the parallel error is what is penalised


def test_a_large_group_of_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=64).astype("<f4")
    rest = [(1000 + i, (v + 0.1 * rng.normal(size=64)).astype("<f4").tobytes()) for i in range(30)]
    rows = [(i, v.tobytes()) for i in range(200)] + rest
    got: dict[int, set] = {}
    for r in N.nearest(_table(spark, rows), "id", "blob", 10, 64).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert got[150] == set(range(10)) and got[3] == set(range(11)) - {3} and len(got) == 230
    assert all(g == set(range(10)) for i, g in got.items() if i >= 1000 and not g & set(range(1000, 1030)))


def test_recall_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "cells_for", lambda n: 76)  # twice as many as there would be
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(4000, 16)) @ rng.normal(size=(16, 64))).astype("<f4")
    got: dict[int, set] = {}
    for r in N.nearest(_table(spark, [(i, v.tobytes()) for i, v in enumerate(x)]), "id", "blob", 10, 64).collect():
        got.setdefault(r.id, set()).add(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(float) @ u.T.astype(float)
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(got[i] & set(want[i].tolist())) / 10 for i in range(4000)]) >= 0.9
