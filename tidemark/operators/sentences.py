"""Sentence-level operators: sentiment, risk tiers, alignment, boilerplate, training pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.lexicons import BOILERPLATE_TERMS, CATEGORIES, CRITICAL_TERMS, HIGH_TERMS, MEDIUM_TERMS, NEGATIONS, SCOPE_BREAKERS

TIERS = {"critical": CRITICAL_TERMS, "high": HIGH_TERMS, "medium": MEDIUM_TERMS, "boilerplate": BOILERPLATE_TERMS}
MOST_SENTENCES = 300


def lexicon_table(rows: DataFrame) -> DataFrame:
    """(word, category) from a wide table (Word, Negative, Positive, ...): any value but null and 0 counts, also a negative year of removal."""
    names = {c.strip().lower(): c for c in rows.columns}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(names[c]).cast("double").alias("v")) for c in CATEGORIES if c in names]))
    return rows.select(F.lower(F.trim(F.col(names["word"]))).alias("word"), pairs.alias("x")).where("x.v is not null and x.v <> 0").select("word", "x.category")


def lexicon_of(spark, words: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(w, c) for w, cs in words.items() for c in cs], "word string, category string")


def _negated(words: Column, pos: Column, reach: int = 5) -> Column:
    """Whether the nearest negation or scope breaker among the ``reach`` words before is a negation."""
    back = F.slice(words, F.greatest(pos - reach, F.lit(0)) + 1, F.least(pos, F.lit(reach)))
    marks = F.filter(back, lambda t: t.isin(NEGATIONS + SCOPE_BREAKERS))
    return F.when(F.size(marks) > 0, F.element_at(marks, -1).isin(NEGATIONS)).otherwise(False)


def sentiment(docs: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Share of the words of each text in each category, by context: a negation turns negative
    and positive around and takes the other categories out. Texts without words have 0 everywhere.

    The lexicon is a dimension table; Spark broadcasts it by its size.
    """
    docs = docs.where(F.col(text).isNotNull())
    sents = docs.select(key, F.explode(T.sentences(F.col(text))).alias("s")).select(key, T.tokens(F.col("s")).alias("w"))
    hits = sents.select(key, "w", F.posexplode("w").alias("pos", "word")).join(lexicon, "word")
    flip = F.when(F.col("category") == "negative", "positive").when(F.col("category") == "positive", "negative")
    counted = hits.select(key, F.when(_negated(F.col("w"), F.col("pos")), flip).otherwise(F.col("category")).alias("category"))
    counts = counted.groupBy(key).agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
    total = docs.select(key, F.size(T.tokens(F.col(text))).alias("n_"))
    return total.join(counts, key, "left").select(key, *[T.ratio(F.coalesce(F.col(c), F.lit(0)), F.col("n_")).alias(c) for c in CATEGORIES])


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether any term stands in the text, inside longer words too."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def risk_tiers(rows: DataFrame, key: str, text: str, lexicon: DataFrame, tiers: dict[str, list[str]] = TIERS) -> DataFrame:
    """(key, level, score) of each sentence, by its terms and, without any, by its sentiment."""
    low = F.lower(F.col(text))
    has = {k: has_any(low, v) for k, v in tiers.items()}
    rows = rows.where(F.col(text).isNotNull())
    # whole sentences are scored as they are: one sentence a row
    words = rows.select(key, T.tokens(F.col(text)).alias("w"))
    hits = words.select(key, "w", F.posexplode("w").alias("pos", "word")).join(lexicon, "word")
    flip = F.when(F.col("category") == "negative", "positive").when(F.col("category") == "positive", "negative")
    counted = hits.select(key, F.when(_negated(F.col("w"), F.col("pos")), flip).otherwise(F.col("category")).alias("category")).groupBy(key).agg(*[F.count_if(F.col("category") == c).alias(c) for c in ("negative", "uncertainty", "litigious")])
    j = rows.select(key, *[v.alias(f"is_{k}") for k, v in has.items()], F.size(T.tokens(F.col(text))).alias("n_")).join(counted, key, "left")
    neg, unc, lit = (T.ratio(F.coalesce(F.col(c), F.lit(0)), F.col("n_")) for c in ("negative", "uncertainty", "litigious"))
    as_ = lambda level, score: F.struct(F.lit(level).alias("level"), (score if isinstance(score, Column) else F.lit(score)).alias("score"))
    tier = (
        F.when(F.col("is_boilerplate") & ~F.col("is_critical") & ~F.col("is_high"), as_("boilerplate", 0.05))
        .when(F.col("is_critical"), as_("critical", 0.95))
        .when(F.col("is_high"), as_("high", F.when(neg > 0.05, 0.8).otherwise(0.7)))
        .when(F.col("is_medium"), as_("medium", F.when(neg > 0.05, 0.55).otherwise(0.45)))
        .when(neg + 0.5 * unc + 0.5 * lit > 0.08, as_("medium", 0.35))
        .otherwise(as_("low", 0.1))
    )
    return j.select(key, tier.alias("t")).select(key, "t.level", "t.score")


def risk_summary(scored: DataFrame, key: str) -> DataFrame:
    """Largest score of a group, its critical and high sentences and its level."""
    g = scored.groupBy(key).agg(F.max("score").alias("max_score"), F.count_if(F.col("score") >= 0.9).alias("critical"), F.count_if((F.col("score") >= 0.6) & (F.col("score") < 0.9)).alias("high"), F.count("*").alias("n"))
    return g.withColumn("level", F.when(F.col("max_score") >= 0.9, "critical").when(F.col("max_score") >= 0.6, "high").when(F.col("max_score") >= 0.3, "medium").otherwise("low"))


def normal(c: Column) -> Column:
    return F.lower(T.stripped(c))


def truncated(sents: Column, most: int = MOST_SENTENCES) -> Column:
    """The first and the last half of ``most`` sentences of a longer list."""
    half = most // 2
    return F.when(F.size(sents) > most, F.concat(F.slice(sents, 1, half), F.slice(sents, -half, half))).otherwise(sents)


def pair_sentences(pairs: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """(section_id, side, no, sentence) of the previous (0) and this (1) text of each pair; with ``most`` only the first and last half of so many (alignment)."""
    sides = pairs.select("section_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("prev_text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("text").alias("t")))).alias("x"))
    sents = T.sentences(F.col("x.t"))
    return sides.select("section_id", "x.side", F.posexplode(truncated(sents, most) if most else sents).alias("no", "sentence")).where(F.length("sentence") >= least)


def exact_changes(sents: DataFrame) -> DataFrame:
    """Sentences of one side whose normal form the other side lacks; repeated ones stay repeated."""
    s = sents.withColumn("norm", normal(F.col("sentence")))
    other = s.select("section_id", (1 - F.col("side")).alias("side"), "norm").distinct()
    return s.join(other, ["section_id", "side", "norm"], "left_anti").select("section_id", F.when(F.col("side") == 1, "added").otherwise("removed").alias("change"), "no", "sentence")


def _by_pair(sents: DataFrame):
    """Sentences with their words, grouped by pair of texts."""
    return sents.select("section_id", "side", "no", T.tokens(F.col("sentence")).alias("w")).groupBy("section_id")


def _cosines(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the previous and of this side's sentences, products of their word counts, and their squared lengths."""
    order = np.lexsort((t["no"].to_numpy(), t["side"].to_numpy()))
    side, no = t["side"].to_numpy()[order], t["no"].to_numpy()[order]
    words = t["w"].combine_chunks().take(pa.array(order))
    code = words.flatten().dictionary_encode()
    counts = np.zeros((len(side), max(1, len(code.dictionary))), np.float64)
    np.add.at(counts, (np.repeat(np.arange(len(side)), np.asarray(pc.list_value_length(words))), code.indices.to_numpy()), 1)
    q = (counts * counts).sum(1)
    k = int((side == 0).sum())
    return no[:k], no[k:], counts[:k] @ counts[k:].T, q[:k], q[k:]


def similar_sentences(sents: DataFrame, least: float = 0.25) -> DataFrame:
    """(section_id, i, j, sim): cosine of word counts of previous sentence i and this side's sentence j.

    One product of two small matrices for each pair of texts, which must be cut to ``MOST_SENTENCES`` before.
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ni, nj, dot, qa, qb = _cosines(t)
        i, j = np.nonzero(dot)
        return pa.table({"section_id": pa.array([key[0].as_py()] * len(i), pa.int64()), "i": pa.array(ni[i].astype(np.int32)), "j": pa.array(nj[j].astype(np.int32)), "dot": pa.array(dot[i, j]), "q": pa.array(qa[i] * qb[j])})

    dots = _by_pair(sents).applyInArrow(run, "section_id bigint, i int, j int, dot double, q double")
    return dots.withColumn("sim", F.round(F.col("dot") / F.sqrt("q"), 6)).where(F.col("sim") >= least).select("section_id", "i", "j", "sim")


def _greedy(sim: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """One-to-one matching in order of (similarity descending, i, j)."""
    i, j = np.nonzero(sim >= least)
    order = np.lexsort((j, i, -sim[i, j]))
    left, right = np.zeros(sim.shape[0], bool), np.zeros(sim.shape[1], bool)
    out = []
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        if not (left[a] or right[b]):
            left[a] = right[b] = True
            out.append((a, b))
    got = np.array(out, int).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def alignment(sents: DataFrame, match: float = 0.55, same: float = 0.85, likely: float = 0.25) -> DataFrame:
    """(section_id, n_prev, n_curr, unchanged, changed, replacements, added, removed) by greedy matching.

    Matches of ``same`` or more are unchanged, of ``match`` or more changed; what
    is left is added or removed, and pairs of it matched at ``likely`` or more are
    likely replacements, which stay counted as added and removed. A pair has no
    more than ``MOST_SENTENCES`` sentences a side.
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ni, nj, dot, qa, qb = _cosines(t)
        length = np.sqrt(qa[:, None] * qb[None])
        sim = np.floor(np.divide(dot, length, out=np.zeros_like(dot), where=length > 0) * 1e6 + 0.5) / 1e6
        i, j = _greedy(sim, match)
        unchanged = int((sim[i, j] >= same).sum())
        rest = sim.copy()
        rest[i], rest[:, j] = -1, -1
        again = len(_greedy(rest, likely)[0])
        return pa.table({c: pa.array([v], pa.int64()) for c, v in (("section_id", key[0].as_py()), ("n_prev", len(ni)), ("n_curr", len(nj)), ("unchanged", unchanged), ("changed", len(i) - unchanged), ("replacements", again))})

    j = _by_pair(sents).applyInArrow(run, "section_id bigint, n_prev bigint, n_curr bigint, unchanged bigint, changed bigint, replacements bigint")
    return j.withColumn("added", F.col("n_curr") - F.col("unchanged") - F.col("changed")).withColumn("removed", F.col("n_prev") - F.col("unchanged") - F.col("changed"))


def corpus_sentences(sections: DataFrame, least: int = 30) -> DataFrame:
    """(norm, company_id, section_id, filing_date, no, sentence) of all sentences of ``least`` characters or more."""
    s = sections.select("company_id", "section_id", "filing_date", F.posexplode(T.sentences(F.col("section_text"))).alias("no", "sentence")).where(F.length("sentence") >= least)
    return s.withColumn("norm", normal(F.col("sentence")))


def boilerplate(sents: DataFrame, least: int = 3) -> DataFrame:
    """Sentences of ``least`` companies or more with their first wording."""
    g = sents.groupBy("norm").agg(F.count_distinct("company_id").alias("companies"), F.count("*").alias("n"), F.min_by("sentence", F.struct("filing_date", "section_id", "no")).alias("first_text"))
    return g.where(F.col("companies") >= least)


def boilerplate_labels(sents: DataFrame) -> DataFrame:
    """(norm, label): 1 for sentences of three companies or more, 0 for those of one; of two there is no label."""
    return sents.groupBy("norm").agg(F.count_distinct("company_id").alias("k")).where("k <> 2").select("norm", F.when(F.col("k") >= 3, 1).otherwise(0).alias("label"))


def uniqueness(sents: DataFrame) -> DataFrame:
    """(section_id, no, others, uniqueness, is_boilerplate): how many other companies say the same."""
    k = sents.groupBy("norm").agg((F.count_distinct("company_id") - 1).alias("others"))
    return sents.join(k, "norm").select("section_id", "no", "others", F.round(F.greatest(F.lit(0.0), 1 - F.col("others") / 10), 4).alias("uniqueness"), (F.col("others") >= 3).alias("is_boilerplate"))


def tier_exact(sents: DataFrame) -> DataFrame:
    """Each previous sentence with the first one of this side of the same normal form: label 1."""
    s = sents.withColumn("norm", normal(F.col("sentence")))
    b = s.where("side = 1").groupBy("section_id", "norm").agg(F.min_by("sentence", "no").alias("text_b"))
    return s.where("side = 0").join(b, ["section_id", "norm"]).select("section_id", "no", F.col("sentence").alias("text_a"), "text_b", F.lit(1.0).alias("label"))


def tier_overlap(sents: DataFrame, least: float = 0.8) -> DataFrame:
    """Each previous sentence without an exact copy, with the sentence of this side of the best word overlap (the first of equals)."""
    s = sents.select("section_id", "side", "no", "sentence", normal(F.col("sentence")).alias("norm"), F.array_distinct(T.tokens(F.col("sentence"))).alias("w"))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        side, no, text, norm, words = (t[c].to_pylist() for c in ("side", "no", "sentence", "norm", "w"))
        mine = sorted((k for k in range(len(side)) if side[k] == 1), key=lambda k: no[k])
        copies = {norm[k] for k in mine}
        size = np.array([len(words[k]) for k in mine])
        where: dict[str, list[int]] = {}
        for at, k in enumerate(mine):
            for w in words[k]:
                where.setdefault(w, []).append(at)
        posted = {w: np.array(x) for w, x in where.items()}
        out: list[tuple] = []
        for k in range(len(side)):
            if side[k] or norm[k] in copies or not words[k]:
                continue
            hits = [posted[w] for w in words[k] if w in posted]
            if len(hits) < least * len(words[k]):
                continue  # even all of them would not do
            both = np.bincount(np.concatenate(hits), minlength=len(mine))
            share = both / (len(words[k]) + size - both)
            best = int(share.argmax())
            if share[best] >= least:
                out.append((no[k], text[k], text[mine[best]], float(share[best])))
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.table({"section_id": pa.array([key[0].as_py()] * len(out), pa.int64()), "no": pa.array(cols[0], pa.int32()), "text_a": pa.array(cols[1], pa.string()), "text_b": pa.array(cols[2], pa.string()), "label": pa.array(cols[3], pa.float64())})

    scored = s.groupBy("section_id").applyInArrow(run, "section_id bigint, no int, text_a string, text_b string, label double")
    return scored.withColumn("label", F.round("label", 4))


#: Sections whose sentences mean different things.
CROSS_SECTIONS = [("risk_factors", "mdna"), ("risk_factors", "business"), ("mdna", "business")]


def tier_cross(sents: DataFrame, cap: int = 33) -> DataFrame:
    """(company_id, section_a, section_b, text_a, text_b, label 0): sentences of two different sections of one company, put together in the order of a seeded hash, up to ``cap`` for each pair of sections; equal wordings of a section count once.

    ``sents`` has (company_id, section, norm, sentence, section_id, no).
    """
    once = sents.groupBy("company_id", "section", "norm").agg(F.min_by("sentence", F.struct("section_id", "no")).alias("sentence"))
    order = Window.partitionBy("company_id", "section").orderBy(F.md5(F.concat(F.lit("42:"), "norm")), "norm")
    n = once.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap)
    pairs = F.broadcast(sents.sparkSession.createDataFrame(CROSS_SECTIONS, "section_a string, section_b string"))  # three rows
    a = n.select("company_id", F.col("section").alias("section_a"), "rn", F.col("sentence").alias("text_a")).join(pairs, "section_a")
    b = n.select("company_id", F.col("section").alias("section_b"), "rn", F.col("sentence").alias("text_b"))
    return a.join(b, ["company_id", "section_b", "rn"]).select("company_id", "section_a", "section_b", "text_a", "text_b", F.lit(0.0).alias("label"))


def tier_critical(sents: DataFrame, terms: list[str] = CRITICAL_TERMS) -> DataFrame:
    """(section_id, no, text_a, text_b, label 0): each added sentence with a critical term, with a removed one of the same pair of texts.

    The n-th such sentence gets the n-th removed one in the order of a seeded hash, beginning again after the last.
    """
    e = exact_changes(sents)
    gone = e.where("change = 'removed'").withColumn("rn", F.row_number().over(Window.partitionBy("section_id").orderBy(F.md5(F.concat(F.lit("42:"), "sentence")), "no")) - 1)
    sized = gone.join(gone.groupBy("section_id").agg(F.count("*").alias("k")), "section_id")
    new = e.where("change = 'added'").where(has_any(F.lower("sentence"), terms)).withColumn("n", F.row_number().over(Window.partitionBy("section_id").orderBy("no")) - 1)
    k = sized.groupBy("section_id").agg(F.first("k").alias("k"))
    j = new.join(k, "section_id").withColumn("rn", F.expr("n % k").cast("int"))
    return j.join(gone.select("section_id", F.col("rn").cast("int").alias("rn"), F.col("sentence").alias("text_b")), ["section_id", "rn"]).select("section_id", "no", F.col("sentence").alias("text_a"), "text_b", F.lit(0.0).alias("label"))


def outcome_pairs(spark, prices: DataFrame | None) -> DataFrame:
    """Pairs anchored in what happened to the price afterwards: empty without prices, not defined with them."""
    if prices is not None:
        raise NotImplementedError("outcomes from prices are not defined")
    return spark.createDataFrame([], "id int, text_a string, text_b string, label double")


def tier_across(sents: DataFrame, least: int = 3) -> DataFrame:
    """The same sentence in ``least`` companies or more: the hub's wording (that of the first company) with each other member's, label 0.9.

    Hub and members say which pairs there are without spelling them all out; ``companies`` is the size of the group.
    """
    one = sents.groupBy("norm", "company_id").agg(F.min_by("sentence", F.struct("section_id", "no")).alias("sentence"))
    hub = one.groupBy("norm").agg(F.min(F.struct("company_id", "sentence")).alias("h"), F.count("*").alias("companies")).where(F.col("companies") >= least)
    return one.join(hub, "norm").where("company_id > h.company_id").select("norm", F.col("h.company_id").alias("company_a"), F.col("company_id").alias("company_b"), F.col("h.sentence").alias("text_a"), F.col("sentence").alias("text_b"), "companies", F.lit(0.9).alias("label"))


def filtered_risk(scored: DataFrame, others: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(key, max_score, level, critical, high, boilerplate_filtered, substantive): summary of scored changes once sentences that ``least`` other companies say count as boilerplate.

    ``scored`` has (key, id, score), ``others`` (id, others); changes without a count are unique.
    """
    s = scored.join(others, "id", "left").withColumn("score", F.when(F.coalesce("others", F.lit(0)) >= least, 0.05).otherwise(F.col("score")))
    g = s.groupBy(key).agg(F.max("score").alias("max_score"), F.count_if(F.col("score") >= 0.9).alias("critical"), F.count_if((F.col("score") >= 0.6) & (F.col("score") < 0.9)).alias("high"), F.count_if(F.col("score") <= 0.05).alias("boilerplate_filtered"), F.count_if(F.col("score") > 0.05).alias("substantive"))
    return g.withColumn("level", F.when(F.col("max_score") >= 0.9, "critical").when(F.col("max_score") >= 0.6, "high").when(F.col("max_score") >= 0.3, "medium").otherwise("low"))


def label_bands(changes: DataFrame) -> DataFrame:
    """(id, label, band) of changed sentences: 0.80 and above as they are, from 0.55 on scaled to at most 0.65."""
    s = F.col("similarity_score")
    rows = changes.where("lower(change_type) = 'changed' and similarity_score is not null and matched_text is not null and length(trim(sentence_text)) >= 20")
    return rows.where(s >= 0.55).select("id", F.round(F.when(s >= 0.8, s).otherwise((s - 0.55) / 0.25 * 0.65), 6).alias("label"), F.when(s >= 0.8, "positive").otherwise("soft").alias("band"))


def negatives(changes: DataFrame, cap: int) -> DataFrame:
    """(drift_score_id, added_id, removed_id): added and removed sentences of one score put together in the order of a seeded hash, up to ``cap`` a score."""
    rows = changes.withColumn("kind", F.lower("change_type")).where("kind in ('added', 'removed')")
    w = Window.partitionBy("drift_score_id", "kind").orderBy(F.md5(F.concat(F.lit("42:"), "id")), "id")
    n = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    a = n.where("kind = 'added'").select("drift_score_id", "rn", F.col("id").alias("added_id"))
    b = n.where("kind = 'removed'").select("drift_score_id", "rn", F.col("id").alias("removed_id"))
    return a.join(b, ["drift_score_id", "rn"]).select("drift_score_id", "added_id", "removed_id")


def quality_report(pairs: DataFrame) -> DataFrame:
    """Number, labels, lengths and vocabulary of training pairs (text_a, label)."""
    words = T.tokens(F.col("text_a"))
    one = pairs.agg(
        F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("mean_label"), F.round(F.stddev_pop("label"), 6).alias("std_label"), F.min("label").alias("min_label"), F.max("label").alias("max_label"),
        F.round(F.avg(F.length("text_a")), 6).alias("mean_chars"), F.round(F.avg(F.size(words)), 6).alias("mean_tokens"), F.count_if(F.col("label") >= 0.5).alias("positive"), F.count_if(F.col("label") < 0.5).alias("negative"),
    )
    vocabulary = pairs.select(F.explode(words).alias("t")).agg(F.count_distinct("t").alias("distinct_tokens"))
    ratio = F.coalesce(F.try_divide(F.col("positive").cast("double"), F.col("negative").cast("double")), F.lit(float("inf")))
    return one.crossJoin(vocabulary).withColumn("pos_neg_ratio", F.round(ratio, 6))  # one row each


def budgeted(tiers: dict[int, DataFrame], total: int, shares: dict[int, float]) -> DataFrame:
    """(tier, text_a, text_b, label): of each tier as many pairs as its share of ``total`` allows, in the order of a seeded hash; equal pairs once."""
    out = None
    for tier, rows in tiers.items():
        one = rows.select(F.lit(tier).alias("tier"), "text_a", "text_b", "label", normal(F.col("text_a")).alias("na"), normal(F.col("text_b")).alias("nb"))
        one = one.groupBy("tier", "na", "nb").agg(F.min(F.struct("text_a", "text_b", "label")).alias("r")).select("tier", "r.*")  # one wording of each pair
        out = one if out is None else out.unionAll(one)
    order = F.md5(F.concat_ws("|", F.lit("42"), "text_a", "text_b"))
    budget = F.create_map(*[F.lit(x) for t, share in shares.items() for x in (t, int(total * share))])
    # the limit of a tier is taken from each partition first, so no tier passes through one task as a whole
    n = out.withColumn("rn", F.row_number().over(Window.partitionBy("tier").orderBy(order, "text_a", "text_b"))).where(F.col("rn") <= max(int(total * s) for s in shares.values()))
    return n.where(F.col("rn") <= budget[F.col("tier")]).drop("rn")


def hash_split(rows: DataFrame, key: str, parts: int = 5) -> DataFrame:
    """The rows with ``held_out``: one of ``parts`` parts by a hash of the key, the same in every run."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("held_out", h % parts == 0)


def rolling_index(rows: DataFrame, key: str, most: int = 50_000) -> DataFrame:
    """The newest ``most`` rows by key; older ones fall out."""
    return rows.orderBy(F.desc(key)).limit(most)
