"""Near copies and shared spans against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import nearcopies as C
from tidemark.llm import spans as S

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def _texts(seed, n, length=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(rng.randrange(5, length))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 3)):
            w = base[:]
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[k] = "edit" + str(rng.randrange(99))
                else:
                    w.insert(k, rng.choice(WORDS))
            out.append((" ".join(w)).title() + rng.choice(("", ".", " !")))
    return out


def _pairs(df):
    links, members = C.near_copies(df, "k", "i", "t")
    return {(r.kind, r.a, r.b) for r in C.all_pairs(links, members).collect()}


def test_near_copies_equal_brute_force(spark):
    texts = _texts(1, 150)
    rows = [("x" if i % 3 else "y", i // 2, t, 0) for i, t in enumerate(texts)] + [("x", 9000, None, 0), ("x", None, texts[0], 0), ("x", 9001, "", 0), ("x", 9002, "short text", 0)]
    rows += rows[:5]
    want = set()
    forms = [(k, i, C.normal_form(t)) for k, i, t, _ in rows if t and i is not None]
    by = defaultdict(dict)
    for k, i, f in forms:
        if len(f) >= C.LEAST_CHARS:
            by[k].setdefault(i, set()).add(f)
    for k, items in by.items():
        ids = sorted(items)
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                if max(C.similarity(f, g) for f in items[a] for g in items[b]) >= C.SIMILARITY:
                    want.add((k, a, b))
    df = spark.createDataFrame(rows, "k string, i bigint, t string, a int")
    assert want and _pairs(df) == want


def test_hot_bucket_in_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 32)
    base = " ".join(WORDS * 3)
    rows = [("x", i, f"{base} tail{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "k string, i bigint, t string")
    assert _pairs(df) == {("x", a, b) for a in range(150) for b in range(a + 1, 150)}


def test_large_copy_groups_are_stars(spark):
    text = " ".join(WORDS)
    rows = [("x", i, text if i < 50 else text + " more") for i in range(51)]
    got = _pairs(spark.createDataFrame(rows, "k string, i bigint, t string"))
    assert {(0, i) for i in range(1, 50)} | {(0, 50)} == {(a, b) for _, a, b in got}


def test_near_copies_of_nothing(spark):
    df = spark.createDataFrame([], "k string, i bigint, t string")
    assert _pairs(df) == set()


def test_hot_buckets_are_banded_again(spark, monkeypatch):
    """Records that share little but a bucket meet only where they agree once more, and none that is similar is lost."""
    monkeypatch.setattr(C, "HOT", 32)
    monkeypatch.setattr(C, "bands_for", lambda n, s: (1, 12))  # short bands: buckets get hot
    rng = random.Random(11)
    shared = " ".join(WORDS[:4])
    texts = [shared + " " + " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(20)) for _ in range(120)]
    texts += [t + " x" for t in texts[:40]]
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "k string, i bigint, t string")
    forms = [C.normal_form(t) for t in texts]
    want = {("x", a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if C.similarity(forms[a], forms[b]) >= C.SIMILARITY}
    assert len(want) >= 40 and _pairs(df) == want


def test_classes_of_copies_and_near_copies(spark):
    text = " ".join(WORDS)
    rows = [("x", i, text if i < 30 else text + " more") for i in range(31)] + [("x", 50, " ".join(WORDS[::-1])), ("x", 51, "short"), ("y", 0, text), ("x", None, text), ("x", 52, None)]
    df = spark.createDataFrame(rows, "k string, i bigint, t string")
    links, members = C.near_copies(df, "k", "i", "t")
    got = {(r.kind, r.id): (r.class_id, r.copies, r.links) for r in C.classes(df, "k", "i", links, members).collect()}
    assert all(got["x", i] == (0, 30, 1) for i in range(30)) and got["x", 30] == (0, 1, 1)
    assert got["x", 50] == (50, 1, 0) and got["x", 51] == (51, 1, 0) and got["x", 52] == (52, 1, 0) and got["y", 0] == (0, 1, 0) and len(got) == 35


def test_bound_never_hides_a_member():
    rng = np.random.default_rng(4)
    sk = rng.integers(0, 1 << 63, (200, 4)).astype(np.uint64)
    sk[50:80] = sk[0] ^ (np.uint64(1) << rng.integers(0, 64, (30, 4)).astype(np.uint64))
    bucket = np.sort(rng.integers(0, 3, 200))
    m = C.Matrix(bucket, sk, np.full(200, 99.0), 50, 0.7)
    i, j = m.pairs()
    got = sorted(tuple(sorted(p)) for p in zip(i.tolist(), j.tolist()))
    agree = C._agree(sk[:, None], sk[None])
    assert got == [(a, b) for a in range(200) for b in range(a + 1, 200) if agree[a, b] >= 50 and bucket[a] == bucket[b]]
    assert got and m.opened < 0.2 * m.tests  # unrelated groups stay shut


def _brute(rows, length):
    where = defaultdict(set)
    texts = [(i, t) for i, t in rows if i is not None and t is not None]
    for i, t in texts:
        for s in range(len(t) - length + 1):
            where[t[s : s + length]].add(i)
    out = set()
    by = defaultdict(set)
    for i, t in texts:
        for s in range(len(t) - length + 1):
            if len(where[t[s : s + length]]) > 1:
                by[i].add(s)
    for i, starts in by.items():
        lo = hi = None
        for s in sorted(starts):
            if hi is not None and s <= hi:
                hi = s + length
                continue
            if hi is not None:
                out.add((i, lo, hi))
            lo, hi = s, s + length
        out.add((i, lo, hi))
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_shared_stretches_equal_brute_force(spark, hot):
    rng = random.Random(7)
    alphabet = "abcd é文"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    common = [make(n) for n in (40, 41, 60, 120, 39)]
    rows = [(i, make(rng.randrange(0, 90)) + rng.choice(common) + make(rng.randrange(0, 90)) + rng.choice(common)) for i in range(60)]
    rows += [(100, "x" * 200), (101, "y" * 10 + "x" * 120), (102, None), (None, common[2]), (103, ""), (104, common[3] * 2)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "i bigint, t string, pos int")
    got = {(r.id, r.start_pos, r.end_pos) for r in S.shared_stretches(df, "i", "t", 40, hot).collect()}
    assert got == _brute(rows, 40)


def test_repetition_inside_one_record_counts_for_nothing(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 20), (2, "z" * 100)], "i bigint, t string")
    assert S.shared_stretches(df, "i", "t", 40).count() == 0
    assert S.shared_stretches(df.limit(0), "i", "t", 40).count() == 0
