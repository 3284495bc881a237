"""Invariants and hand-computed values of the core operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import text as T
from tidemark.functions.lexicons import SAMPLE_SENTIMENT
from tidemark.operators import graph as G
from tidemark.operators import lexical as L
from tidemark.operators import relational as R
from tidemark.operators import sentences as N
from tidemark.operators import series as S
from tidemark.operators import vectors as V

PAIR = "section_id bigint, prev_id bigint, prev_text string, text string, clash string"


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens, "Don't stop 3 Café's U.S. été") == ["don't", "stop", "s", "u", "s"]
    assert one(spark, T.tokens, "") == []
    assert one(spark, T.tokens, None) is None


def test_sentences(spark):
    text = "Dr. Smith met Acme Inc. Then he left. The U.S. Court ruled! Was it 3.5? Yes."
    assert one(spark, T.sentences, text) == ["Dr. Smith met Acme Inc. Then he left.", "The U.S. Court ruled!", "Was it 3.5?", "Yes."]
    assert one(spark, T.sentences, "  \n ") == []


def test_ngrams(spark):
    words = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r.x for r in words.select(T.ngrams(F.col("w"), 2).alias("x")).collect()] == [["a b", "b c"], [], []]


def test_identical_texts_do_not_drift(spark):
    p = spark.createDataFrame([(1, 0, "The board met. It left.", "The board met. It left.", "x"), (2, 0, "", "", "x"), (3, 0, "alpha beta", "gamma delta", None)], PAIR)
    drift = {r.section_id: r for r in L.jaccard_drift(p).collect()}
    assert (drift[1].jaccard_distance, drift[1].added_words, drift[2].jaccard_distance, drift[3].jaccard_distance) == (0.0, 0, 0.0, 1.0)
    info = {r.section_id: r for r in L.information_change(p).collect()}
    assert info[1].kl_divergence == 0.0 and info[1].novelty == 0.0 and info[1].vocabulary_overlap == 1.0
    assert 0 <= info[3].novelty <= 1 and info[3].vocabulary_overlap == 0.0
    obf = {r.section_id: r.obfuscation for r in L.obfuscation(p).collect()}
    assert obf[1] == 0.0 and obf[2] == 0.0


def test_euphemisms(spark):
    p = spark.createDataFrame([(1, 0, "a layoff came", "a headcount adjustment came", None), (2, 0, "a layoff came", "a layoff and headcount adjustment", None)], PAIR)
    assert [(r.section_id, r.term, r.soft) for r in L.softened(p).collect()] == [(1, "layoff", "headcount adjustment")]


def test_chunks(spark):
    d = spark.createDataFrame([(1, "x" * 4100), (2, "short"), (3, "  "), (4, None)], "id int, t string")
    rows = sorted((r.id, r.chunk, r.chunk_chars) for r in L.chunk_windows(d, "id", "t").collect())
    assert rows == [(1, 0, 2000), (1, 1, 2000), (1, 2, 900), (2, 0, 5)]


def test_negation_turns_sentiment(spark):
    lex = N.lexicon_of(spark, SAMPLE_SENTIMENT)
    d = spark.createDataFrame([(1, "Sales declined."), (2, "Sales never declined."), (3, "It never came but sales declined."), (4, "It could not."), (5, ""), (6, None)], "id int, t string")
    got = {r.id: r for r in N.sentiment(d, "id", "t", lex).collect()}
    assert got[1].negative == 0.5 and got[2].positive == pytest.approx(1 / 3) and got[2].negative == 0 and got[3].negative > 0
    assert got[4].uncertainty == pytest.approx(1 / 3) and got[5].negative == 0 and 6 not in got


def test_greedy_matching_is_one_to_one():
    import numpy as np

    i, j = N._greedy(np.array([[0.9, 0.8], [0.85, 0.6]]), 0.55)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (1, 1)]
    assert len(N._greedy(np.zeros((3, 2)), 0.25)[0]) == 0


def test_alignment_of_hand_made_texts(spark):
    p = spark.createDataFrame([(1, 0, "Revenue rose in all of our regions. We closed two plants here. Nothing else was new.", "Revenue rose in all of our regions. We closed three plants here. Dividends were paid in May.", None), (2, 0, "", "One new sentence.", None)], PAIR)
    got = {r.section_id: r for r in N.alignment(N.pair_sentences(p, most=300)).collect()}
    assert (got[1].unchanged, got[1].changed, got[1].added, got[1].removed) == (1, 1, 1, 1)
    assert (got[2].n_prev, got[2].n_curr, got[2].added) == (0, 1, 1)


def test_training_tiers_of_negatives(spark):
    p = spark.createDataFrame([(1, 0, "We hold a strong financial position today. Cash is ample in every one of our units.", "There is substantial doubt about our going concern status. Cash is ample in every one of our units.", None)], PAIR)
    rows = N.tier_critical(N.pair_sentences(p, 30)).collect()
    assert [(r.text_a[:8], r.text_b[:7], r.label) for r in rows] == [("There is", "We hold", 0.0)]
    s = spark.createDataFrame([(1, "mdna", "a", "A", 1, 0), (1, "mdna", "a", "A again", 2, 0), (1, "business", "b", "B", 3, 0), (2, "mdna", "c", "C", 4, 0)], "company_id bigint, section string, norm string, sentence string, section_id bigint, no int")
    assert [(r.section_a, r.text_a, r.text_b) for r in N.tier_cross(s).collect()] == [("mdna", "A", "B")]


def test_truncation(spark):
    d = spark.createDataFrame([([str(i) for i in range(10)],), (["a"],)], "s array<string>")
    assert [r.x for r in d.select(N.truncated(F.col("s"), 4).alias("x")).collect()] == [["0", "1", "8", "9"], ["a"]]


def test_long_texts_are_compared_whole(spark):
    """400 sentences a side: the middle ones are copies, one is new, and the copy of another moved to the middle."""
    old = [f"The board approved plan number {i} for the coming year." for i in range(400)]
    new = [*old[1:200], old[0], "Something entirely new was decided about dividends.", *old[200:]]
    s = N.pair_sentences(spark.createDataFrame([(1, 0, " ".join(old), " ".join(new), None)], PAIR), 30)
    assert [(r.change, r.no) for r in N.exact_changes(s).collect()] == [("added", 200)]
    assert N.tier_exact(s).count() == 400
    assert N.pair_sentences(spark.createDataFrame([(1, 0, " ".join(old), " ".join(new), None)], PAIR), most=300).groupBy("side").count().where("count = 300").count() == 2


def _drift(spark, values, company=1):
    rows = [(i, company, i, "mdna", "10-K", dt.date(2015 + i, 3, 1), v, 0.1, 1, 1, '{"negative": %f}' % (0.01 * i), dt.datetime(2020, 1, 1)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, company_id bigint, filing_id bigint, section string, form string, filing_date date, cosine double, jaccard double, added_words int, removed_words int, sentiment_delta string, computed_at timestamp")


def test_anomaly(spark):
    got = {r.filing_id: r for r in S.company_anomaly(S.base(_drift(spark, [0.09, 0.10, 0.11, 0.10, 0.50]))).collect()}
    assert got[2].z is None and got[4].level == "extreme" and got[0].level == "normal"
    flat = {r.filing_id: r for r in S.company_anomaly(S.base(_drift(spark, [0.1] * 4 + [0.35]))).collect()}
    assert flat[4].z is None and flat[4].level == "high"


def test_trends_and_streaks(spark):
    s = S.base(_drift(spark, [0.1, 0.1, 0.11, 0.12, 0.4]))
    t = S.trends(s).first()
    assert t.drift_acceleration and t.drift_spike and t.sentiment_deterioration and not t.elevated_baseline
    assert S.streaks(s).first().streak == 4
    assert S.trends(S.base(_drift(spark, [0.1, 0.2, 0.3]))).count() == 0


def test_derivative_counts(spark):
    d = S.derivatives(S.base(_drift(spark, [0.1, 0.2, 0.15, 0.3, 0.2])))
    assert [d.where(f"{c} is not null").count() for c in ("velocity", "acceleration", "jerk")] == [4, 3, 2]


def test_backtest_reads_the_stored_sentiment(spark, tmp_path):
    """Filing 2 turns bad by 0.07; the 0.005 of filing 4 is no bad outcome."""
    from tidemark.plans import series as P

    drift = [(1, 1, 1, "mdna", 0.9, 0.001), (2, 1, 2, "mdna", 0.1, 0.07), (3, 1, 3, "mdna", 0.8, 0.001), (4, 1, 4, "mdna", 0.2, 0.005)]
    rows = [(i, c, f, s, v, v, 1, 1, '{"negative": %.4f}' % n, dt.datetime(2020, 1, 1)) for i, c, f, s, v, n in drift]
    names = "id bigint, company_id bigint, filing_id bigint, section_type string, cosine_distance double, jaccard_distance double, added_words int, removed_words int, sentiment_delta string, computed_at timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/drift_scores.parquet")
    filings = [(i, 1, "10-K", dt.date(2015 + i, 3, 1), "done", f"a-{i}") for i in range(1, 5)]
    spark.createDataFrame(filings, "id bigint, company_id bigint, form_type string, filing_date date, status string, accession_number string").write.parquet(f"{tmp_path}/filings.parquet")
    got = {r.section: (r.n, r.high, r.hits, r.bad, r.precision, r.recall) for r in P.backtest_metrics(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(("all", "mdna"), (3, 1, 1, 1, 1.0, 1.0))


def test_leave_one_out(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("b", 5.0)], "g string, x double")
    got = {r.x: (r.peers, r.peer_mean, r.peer_std) for r in S.leave_one_out(d, ["g"], "x").collect()}
    assert got[1.0] == (2, 4.0, 2.0) and got[6.0][1] == pytest.approx(1.5) and got[5.0] == (0, None, 0.0)


def test_previous_filing_skips_the_same_day(spark):
    rows = [(1, 1, "10-K", dt.date(2020, 1, 1)), (2, 1, "10-K", dt.date(2020, 1, 1)), (3, 1, "10-K", dt.date(2021, 1, 1)), (4, 1, "10-Q", dt.date(2021, 1, 1))]
    f = spark.createDataFrame(rows, "filing_id bigint, company_id bigint, form string, filing_date date")
    assert {r.filing_id: r.prev_filing_id for r in R.previous_filing(f).collect()} == {1: None, 2: None, 3: 2, 4: None}


def test_arguments_are_checked(spark):
    c = spark.createDataFrame([(1, "AB", "x")], "id bigint, ticker string, name string")
    with pytest.raises(ValueError):
        R.lookup(c, "A-B")
    with pytest.raises(ValueError):
        R.search_companies(c, "a", 0)
    assert R.lookup(c, "ab").count() == 1 and R.search_companies(c, "zz").count() == 0


def test_zipped_rows(spark):
    m = spark.createDataFrame([(1, ["a", "b", "c"], ["10-K", "10-Q", "10-K"], ["2020-01-01", ""])], "k int, acc array<string>, form array<string>, filing_date array<string>")
    rows = R.zipped_rows(m, ["acc", "form", "filing_date"], ["10-K"], "2019-01-01", "2019-12-31").collect()
    assert [(r.acc, r.filing_date) for r in rows] == [("c", None)]


def test_similar_pairs_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(V, "BLOCK", 10)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(45)] + [(99, [0.0] * 4), (100, None)]
    got = {(r.a, r.b) for r in V.similar_pairs(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v", 0.5).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    want = {(i, j) for i, a in rows[:45] for j, b in rows[:45] if i < j and cos(a, b) >= 0.5}
    assert got == want


def test_graph_measures(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node bigint")
    e = spark.createDataFrame([(0, 1, 0.8), (1, 2, 0.8), (0, 2, 0.8), (3, 4, 0.5)], "a bigint, b bigint, sim double")
    assert {r.node: r.component for r in G.components(nodes, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert {r.node: r.coefficient for r in G.clustering(e).collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}
    path = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "a bigint, b bigint, sim double")
    assert {r.node: r.betweenness for r in G.betweenness(nodes.where("node < 3"), path).collect()} == {0: 0.0, 1: 1.0, 2: 0.0}
    assert {r.hops: r.pairs for r in G.path_lengths(path).collect()} == {1: 4, 2: 2}


def test_spectral_gap_of_large_graphs(spark):
    import random

    rng = random.Random(8)
    pairs = {(min(a, b), max(a, b)) for a, b in ((i, rng.randrange(5200)) for i in range(5200) for _ in range(4)) if a != b}
    e = spark.createDataFrame([(a, b, 0.3 + 0.7 * rng.random()) for a, b in sorted(pairs)], "a bigint, b bigint, sim double")
    assert 0.1 < G.spectral_gap(e) < 1
    few = e.where("a < 400 and b < 400")
    assert G.spectral_gap(few, 10) == pytest.approx(G.spectral_gap(few), abs=1e-6)


def _communities(spark, n, edges):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node bigint")
    return {r.node: r.community for r in G.communities(nodes, spark.createDataFrame(edges, "a bigint, b bigint, sim double")).collect()}


def test_communities_do_not_swap_labels(spark):
    assert len(set(_communities(spark, 2, [(0, 1, 0.5)]).values())) == 1
    cliques = [(i, j, 0.9) for lo in (0, 5) for i in range(lo, lo + 5) for j in range(i + 1, lo + 5)]
    got = _communities(spark, 11, [*cliques, (4, 5, 0.3)])
    assert [len({got[i] for i in part}) for part in (range(5), range(5, 10))] == [1, 1] and got[0] != got[9] and got[10] == 10


def test_communities_end_where_no_node_would_change(spark):
    ring = [(i, i + 1, 0.5 + 0.001 * i) for i in range(39)] + [(0, 39, 0.5)]
    got = _communities(spark, 40, ring)
    for i in range(40):
        votes: dict[int, float] = {}
        for a, b, w in ring:
            if i in (a, b):
                other = got[b if a == i else a]
                votes[other] = votes.get(other, 0.0) + w
        assert votes.get(got[i], 0.0) >= max(votes.values()) - 1e-9


def test_plain_text_and_sections():
    html = "<html><head><style>p {}</style></head><body><script>x()</script><p>One &amp;  two</p><b>three</b></body></html>"
    assert D.plain_text(html) == "One & two\nthree"
    assert D.plain_text(None) is None
    body = "The company faces many risks in each of its markets and cannot say which of them will matter most. " * 10
    text = f"Item 1A. Risk Factors\n{body}\nItem 7. Management's Discussion\n{body}"
    assert [k for k, _ in D.sections_of(text, "10-K")] == ["mdna", "risk_factors"]
    assert D.sections_of(text, "S-1") == [("full_text", text)]
    assert D.sections_of("nothing here", "10-K") == [("full_text", "nothing here")]
    assert D.is_stub("See Item 7.") and D.is_stub("Item 1B. None.") and not D.is_stub(body)


def test_sections_by_form_contents_stubs_and_notes():
    from tidemark.functions import filings as P

    body = "We sell goods to many customers in many places and expect that to continue for years to come. " * 12
    contents = "Table of Contents\nItem 1A. Risk Factors 12\nItem 7. MD&A 30\nItem 8. Statements 44\n"
    text = f"{contents}{body}\nItem 1A. Risk Factors\n{body}\nItem 3. Legal Proceedings\nSee Note 15 to the statements.\nItem 8. Statements\n{body}\nNote 15 Legal matters\n{body}\nNote 16 Leases\nnone"
    got = dict(P.sections_of(P.without_contents(text), "10-K"))
    assert set(got) == {"risk_factors", "financial_statements", "legal_proceedings"} and got["legal_proceedings"].startswith("Note 15")
    assert P.without_contents(text).startswith("We sell")
    ten_q = f"Part II\nItem 1. Legal\n{body}\nItem 1A. Risk Factors\n{body}"
    assert [k for k, _ in P.sections_of(ten_q, "10-Q")] == ["financial_statements", "risk_factors"]  # a heading inside another one cuts it short
    eight = f"Item 2.02 Results of Operations\n{body}\nItem 9.01 Exhibits\n{body}"
    assert [k for k, _ in P.sections_of(eight, "8-K")] == ["financial_exhibits", "results_of_operations"]
    titled = f"Item 2. Properties\nA short one with more than ten words in a single sentence so that it counts.\nItem 8. Financial Statements\n{body}\nRISK FACTORS\n{body}"
    assert "risk_factors" in dict(P.sections_of(titled, "10-K"))  # by its title, as a section is short


def test_inline_tags_and_preamble():
    from tidemark.functions import filings as P

    html = '<div><ix:nonNumeric name="us-gaap:RiskFactorsTextBlock"><p>Many  risks.</p><p>More.</p></ix:nonNumeric><ix:nonNumeric name="dei:Other">x</ix:nonNumeric></div>'
    assert P.parse_filing(html, "10-K") == [("risk_factors", "Many risks.\nMore.")]
    assert P.parse_filing("<p>only this</p>", "10-K") == [("full_text", "only this")] and P.parse_filing(None, None) == []
    junk = "\n".join(f"http://x.org/{i}" for i in range(60))
    assert P.without_preamble(junk + "\nThis line has more than six words.") == "This line has more than six words."
    assert P.without_preamble("http://x.org\nText of one or two words") == "http://x.org\nText of one or two words"


def test_stub_expression_equals_the_function(spark):
    texts = ["None.", "Item 1B. Not applicable", "See Item 7 below.", "Too short.", "This one is a sentence of well over ten words, though short.", "x " * 250, "", "The exhibit is\nincorporated by reference."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(D.stub_col(F.col("t")).alias("s")).collect()] == [D.is_stub(t) for t in texts]


def test_html_clean_reads_texts_with_entities_alone(spark, tmp_path):
    from tidemark.plans import documents as P

    spark.createDataFrame([(1, "Profit &amp; loss"), (2, "<b>Bold</b> text"), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in P.html_clean(spark, str(tmp_path)).collect()}[1] == "Profit & loss"


def test_diff():
    assert D.diff_stats("A b. C d.", "A b. C d.") == (0, 0, 0, 1.0)
    assert D.diff_stats("A b. C d.", "A b. X y. C d.")[0] == 1
    assert D.unified("A.", "A.") == ""
