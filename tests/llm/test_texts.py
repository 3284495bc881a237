"""Chunking, packing, leaks and languages."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chunking as K
from tidemark.llm import langid as L
from tidemark.llm import leaks as E
from tidemark.llm import packing as P
from tidemark.llm.segment import unit_spans

TEXT = "The audit committee met in May. Revenue rose by 3.1% over 2019. " * 120


def _sound(text, limit=2000, overlap=200):
    kind, made = K.pieces(text, limit, overlap)
    assert made[0][0] == 0 and made[-1][1] == len(text)
    assert all(e - s <= limit for s, e, _ in made)
    assert all(b[0] == a[1] - overlap for a, b in zip(made, made[1:]))
    assert text == text[: made[0][1]] + "".join(text[s + overlap : e] for s, e, _ in made[1:])
    assert kind == ("forced" if any(e - s > limit for s, e in unit_spans(text)) else "natural")
    return kind, made


def test_pieces():
    kind, made = _sound(TEXT)
    assert kind == "natural" and all(at for _, _, at in made)
    assert _sound("x" * 9000)[0] == "forced"
    assert _sound(TEXT[:500])[1] == [(0, 500, True)]
    assert _sound(TEXT + "word " * 1000 + "\n\n" + TEXT)[0] == "forced"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["A b c. ", "x" * 30, "\n\n", "Long words here and there. ", " "]), max_size=120), st.integers(60, 200))
def test_pieces_of_any_text(parts, limit):
    text = "".join(parts)
    if text:
        _sound(text, limit, limit // 10)


def test_edits_move_neighbouring_cuts_only():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))).title() + "." for _ in range(6000))
    before = {text[e - 40 : e] for _, e, _ in K.pieces(text)[1]}
    edited = text[:3000] + "An edit. " + text[3000:]
    after = {edited[e - 40 : e] for _, e, _ in K.pieces(edited)[1]}
    assert len(before & after) > 0.5 * len(before)


def test_forced_means_a_unit_that_no_piece_holds():
    long, fits = "word " * 500 + "end.", "Word " + "word " * 388 + "end."
    assert K.pieces(f"A sentence. {long} Another sentence.")[0] == "forced"
    kind, made = K.pieces(" ".join([fits] * 4))
    assert kind == "natural" and not all(at for _, _, at in made)  # the overlap leaves too little room, and the piece says so


def test_frequent_lengths_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "NUMBERED", 7)
    df = spark.createDataFrame([(i, "a few words here" if i % 3 else "others " * (i % 5)) for i in range(90)], "i bigint, t string")
    rows = P.packed(df, "i", "t", (8, 16)).collect()
    held: dict[int, int] = {}
    for r in rows:
        if r.token_end > r.token_start:
            held[r.container_id] = held.get(r.container_id, 0) + r.token_end - r.token_start
    size = {r.container_id: r.container_size for r in rows}
    assert len(rows) >= 90 and all(n <= size[c] for c, n in held.items())


def test_pieces_table(spark):
    df = spark.createDataFrame([(1, TEXT, 1), (2, None, 1), (3, "short", 1), (None, TEXT, 1)], "i bigint, t string, piece_no int")
    rows = K.text_pieces(df, "i", "t").collect()
    assert {r.key for r in rows} == {1, None} and K.text_pieces(df.limit(0), "i", "t").count() == 0


def test_fillings_hold_everything():
    rng = random.Random(2)
    counts = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 2049), 300)}
    for sizes in ((2048,), (512, 1024, 2048)):
        plan = P.plan_fillings(counts, sizes)
        held: dict[int, int] = {}
        for used, times, size in plan:
            assert sum(n * c for n, c in used.items()) <= size and size in sizes
            for n, c in used.items():
                held[n] = held.get(n, 0) + c * times
        assert held == counts
    total = sum(n * c for n, c in counts.items())
    allotted = lambda sizes, plan: sum(t * s for _, t, s in plan)
    joint = allotted(None, P.joint_plan(counts, (512, 1024, 2048)))
    assert joint <= allotted(None, P.plan_fillings(counts, (512, 1024, 2048))) and joint <= allotted(None, P.plan_fillings(counts, (2048,)))
    assert sum(t for _, t, _ in P.plan_fillings(counts, (2048,))) * 2048 < 1.03 * total


def test_packed(spark):
    rng = random.Random(3)
    words = "the board met revenue rose committee plan".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 50, 700, 5000)))) for _ in range(120)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(500, None, 1), (501, "", 1), (502, "<|endoftext|>", 1)] + [(i + 1000, texts[3], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "i bigint, t string, salt int")
    for sizes in ((2048,), (256, 2048)):
        got = P.packed(df, "i", "t", sizes).collect()
        size: dict[int, int] = {}
        used: dict[int, int] = {}
        by: dict[int, list] = {}
        for r in got:
            used[r.container_id] = used.get(r.container_id, 0) + r.token_end - r.token_start
            assert size.setdefault(r.container_id, r.container_size) == r.container_size
            by.setdefault(r.key, []).append((r.part_no, r.token_start, r.token_end))
        assert all(used[c] <= size[c] for c in used)
        assert set(by) == {r[0] for r in rows if r[1] is not None}
        for parts in by.values():
            parts.sort()
            assert parts[0][1] == 0 and all(a[2] == b[1] for a, b in zip(parts, parts[1:])) and all(e - s == 2048 for _, s, e in parts[:-1])
    assert P.packed(df.limit(0), "i", "t").count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 60)))) for i in range(20)]
    docs = []
    for d in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        if d % 2:
            part = items[rng.randrange(20)][1].split()
            a = rng.randrange(len(part))
            w[len(w) // 2 : len(w) // 2] = part[a : a + rng.randrange(8, 40)]
        t = rng.choice((" ", ", ", "  \n", " ­")).join(w)
        docs.append((d, t.upper() if d % 3 == 0 else t, 1))
    items += [(50, "監査委員会は株式を保有し規制強化に対応した、一方で当社の通信部門は金利変動の影響を受け資金繰りには影響がなかった。" * 2), (51, None), (52, "")]
    cjk = items[20][1]
    docs += [(900, "x 。" + cjk[3:30] + " " + cjk[30:60], 1), (901, cjk[:36], 1), (902, None, 1), (903, "", 1), (904, "ﬁ", 1)]
    want = set()
    for d, t, _ in docs:
        for i, q in items:
            if not t or not q:
                continue
            a, b = E.matching_form(t), E.matching_form(q)
            if i == 50:
                a, b = a.replace(" ", ""), b.replace(" ", "")
                hit = any(b[k : k + 40] in a for k in range(len(b) - 39))
            else:
                x, y = f" {a} ", b.split()
                hit = any(f" {' '.join(y[k : k + 16])} " in x for k in range(len(y) - 15))
            if hit:
                want.add((d, i))
    out = E.leaked_items(spark.createDataFrame(docs, "d bigint, t string, item_id int"), "d", "t", spark.createDataFrame(items, "i bigint, t string"), "i", "t")
    got = {(r.doc_id, r.item_id) for r in out.where("passage and shared_windows > 0").collect()}
    assert want and got == want


def test_short_items_are_found_as_a_whole(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"before {item.title()}, and after"), (2, item.replace("six", "sixty")), (3, "one two three four five")]
    out = E.leaked_items(spark.createDataFrame(docs, "d bigint, t string"), "d", "t", spark.createDataFrame([(7, item), (8, "too short"), (9, "日本語の短い文章です今日も")], "i bigint, t string"), "i", "t")
    assert [(r.doc_id, r.item_id, r.shared_windows, r.item_share, r.passage) for r in out.collect()] == [(1, 7, 1, 1.0, False)]


def test_near_copies_of_items_are_reported(spark):
    words = [f"word{i}" for i in range(60)]
    near = words[:20] + ["other"] + words[21:40] + ["another"] + words[41:]
    out = E.leaked_items(spark.createDataFrame([(1, " ".join(near))], "d bigint, t string"), "d", "t", spark.createDataFrame([(7, " ".join(words))], "i bigint, t string"), "i", "t")
    r = out.first()
    assert r.passage and r.shared_windows == 5 + 4 + 4 and 0.8 < r.item_share < 1  # 20, 19 and 19 words stand as they were


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_CHARS", 200)
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words)], "d bigint, t string")
    items = spark.createDataFrame([(i, words if i == 3 else f"other {i} " * 20) for i in range(6)], "i bigint, t string")
    assert [(r.doc_id, r.item_id) for r in E.leaked_items(docs, "d", "t", items, "i", "t").where("shared_windows > 0").collect()] == [(1, 3)]
    assert E.leaked_items(docs, "d", "t", items.limit(0), "i", "t").count() == 0


def test_simhash_windows_in_radius_are_all_found():
    form = " ".join(f"word{i}" for i in range(30))
    index = E._Index([(1, form)], False, E.WORDS)
    near = form.replace("word3 ", "changed ")
    assert any(item == 1 and shared > 0 for item, shared, _ in index.look_up(E._features(near, False)))


@pytest.mark.parametrize("label,code", [("en", "en"), ("EN-us", "en"), ("English", "en"), (" de_AT ", "de"), ("zh-Hans", "zh"), ("jpn", "ja"), (None, ""), ("und", ""), (" Unknown", ""), ("xx", None), ("klingon", None)])
def test_labels(label, code):
    assert L.code_of(label) == code


def test_repair():
    assert L.repaired("El comité".encode().decode("cp1252")) == "El comité"
    assert L.repaired("São Paulo, Ã alone") == "São Paulo, Ã alone"


def test_held_out_accuracy(spark, base):
    docs = spark.read.parquet(f"{base}/../sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect() if r.text and L.code_of(r.lang)]
    fitted = L.fit([(L.code_of(lang), t) for i, t, lang in rows if i % 2])
    ok = n = 0
    for i, t, lang in rows:
        if i % 2 == 0 and len(t) > 300:
            form = L.letters(t)
            n += 1
            ok += fitted.codes[int(fitted.distances([form])[0].argmin())] == L.code_of(lang)
    assert ok / n > 0.85  # about a tenth of the labels is wrong by design


def test_mixed_documents(spark, base):
    docs = spark.read.parquet(f"{base}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    en = "The audit committee depends on many suppliers and could be harmed by claims of the holders."
    fr = "Le conseil de la société pourrait être affecté par des litiges malgré les contrôles renforcés depuis lors."
    own = [(10**6, f"{en} {en}\n\n{fr}", "en"), (10**6 + 1, en, "en-GB"), (10**6 + 2, fr, None), (10**6 + 3, "12 | 13", None), (10**6 + 4, None, "en"), (10**6 + 5, "", "en"), (10**6 + 6, fr, "nonsense")]
    found = L.stretches(docs.unionAll(spark.createDataFrame(own, "doc_id bigint, text string, lang string")), "doc_id", "text", "lang")
    got = {}
    for r in L.misfits(found).where(f"id >= {10**6}").collect():
        got.setdefault(r.id, []).append((r.start_pos, r.lang_code))
    assert {k: sorted(v) for k, v in got.items()} == {10**6: [(0, "en"), (2 * len(en) + 3, "fr")], 10**6 + 2: [(0, "fr")], 10**6 + 6: [(0, "fr")]}
    assert L.stretches(docs.limit(0), "doc_id", "text", "lang").count() == 0
