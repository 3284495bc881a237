"""Queries on sentences: sentiment, risk, alignment, boilerplate, training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.lexicons import CATEGORIES, NEGATIONS, SAMPLE_SENTIMENT, SAMPLE_TIERS, SCOPE_BREAKERS
from tidemark.operators import models as M
from tidemark.operators import sentences as N
from tidemark.plans.views import P_SQL, S_SQL, clean_sections, section_pairs, sent_sql, strip_sql, tok_sql, values_sql, words_sql
from tidemark.session import stored
from tidemark.sources.tables import table


def _lexicon(spark: SparkSession) -> DataFrame:
    return N.lexicon_of(spark, SAMPLE_SENTIMENT)


def lexicon_from_wide(spark: SparkSession, base: str) -> DataFrame:
    """The sample lexicon from its wide form."""
    rows = [(w.upper(), *(2009 if c in cs else (-2020 if c == "litigious" and w == "late" else 0) for c in CATEGORIES)) for w, cs in SAMPLE_SENTIMENT.items()]
    return N.lexicon_table(spark.createDataFrame(rows, "`Word ` string, " + ", ".join(f"`{c.title()}` int" for c in CATEGORIES)))


def sentiment_contextual(spark: SparkSession, base: str) -> DataFrame:
    s = N.sentiment(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text", _lexicon(spark))
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in CATEGORIES])


def pair_sentiment_delta(spark: SparkSession, base: str) -> DataFrame:
    p = section_pairs(spark, base)
    a = N.sentiment(p.select("section_id", "prev_text"), "section_id", "prev_text", _lexicon(spark)).select("section_id", *[F.col(c).alias(f"{c}_") for c in CATEGORIES])
    b = N.sentiment(p.select("section_id", "text"), "section_id", "text", _lexicon(spark))
    return a.join(b, "section_id").select("section_id", *[F.round(F.col(c) - F.col(f"{c}_"), 6).alias(c) for c in CATEGORIES])


def _risk(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "sentence_changes", "id", "drift_score_id", "sentence_text")
    return N.risk_tiers(c, "id", "sentence_text", _lexicon(spark), SAMPLE_TIERS)


def sentence_risk_tiers(spark: SparkSession, base: str) -> DataFrame:
    return _risk(spark, base)


def risk_summary(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "sentence_changes", "id", "drift_score_id")
    return N.risk_summary(_risk(spark, base).join(c, "id"), "drift_score_id")


def sentence_exact_changes(spark: SparkSession, base: str) -> DataFrame:
    e = N.exact_changes(N.pair_sentences(section_pairs(spark, base)))
    return e.select("section_id", "change", F.col("no").alias("sentence_index"), F.md5("sentence").alias("sentence_hash"))


def sentence_similarity(spark: SparkSession, base: str) -> DataFrame:
    return N.similar_sentences(N.pair_sentences(section_pairs(spark, base), most=N.MOST_SENTENCES), 0.55)


def sentence_alignment(spark: SparkSession, base: str) -> DataFrame:
    return N.alignment(N.pair_sentences(section_pairs(spark, base), most=N.MOST_SENTENCES))


def head_tail_truncate(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents", "doc_id", "text").where("text is not null")
    s = N.truncated(T.sentences(F.col("text")), 6)
    return d.select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("kept"))


def risk_filtered(spark: SparkSession, base: str) -> DataFrame:
    """Risk of each score's changes once sentences that three other companies add or remove as well count as boilerplate."""
    c = table(spark, base, "sentence_changes", "id", "drift_score_id", "sentence_text")
    d = table(spark, base, "drift_scores", "id", "company_id").select(F.col("id").alias("drift_score_id"), "company_id")
    k = c.join(d, "drift_score_id").withColumn("norm", N.normal(F.col("sentence_text")))
    others = k.join(k.groupBy("norm").agg((F.count_distinct("company_id") - 1).alias("others")), "norm").select("id", "others")
    return N.filtered_risk(_risk(spark, base).join(c.select("id", "drift_score_id"), "id"), others, "drift_score_id")


def risk_entries(spark: SparkSession, base: str) -> DataFrame:
    """Changes of each score in order of risk, with the first 120 characters of their sentences."""
    from pyspark.sql import Window

    c = table(spark, base, "sentence_changes", "id", "drift_score_id", "sentence_text")
    j = _risk(spark, base).join(c, "id")
    w = Window.partitionBy("drift_score_id").orderBy(F.desc("score"), "id")
    return j.select("drift_score_id", "id", "level", "score", F.row_number().over(w).alias("rank"), F.substring("sentence_text", 1, 120).alias("excerpt"))


def risk_labels(spark: SparkSession, base: str) -> DataFrame:
    """Training labels of changed sentences by their terms: boilerplate counts as low, texts under 20 characters have none."""
    c = table(spark, base, "sentence_changes", "id", "sentence_text").where("length(trim(sentence_text)) >= 20").select("id")
    level = F.when(F.col("level") == "boilerplate", "low").otherwise(F.col("level"))
    code = F.when(level == "critical", 3).when(level == "high", 2).when(level == "medium", 1).otherwise(0)
    return _risk(spark, base).join(c, "id").select("id", level.alias("risk_level"), code.alias("label"), "score")


def _corpus(spark: SparkSession, base: str) -> DataFrame:
    return N.corpus_sentences(clean_sections(spark, base, "section_text").where("section_text is not null"))


def boilerplate_sentences(spark: SparkSession, base: str) -> DataFrame:
    return N.boilerplate(_corpus(spark, base)).select(F.md5("norm").alias("sentence_hash"), "companies", "n", F.md5("first_text").alias("first_hash"))


def boilerplate_labels(spark: SparkSession, base: str) -> DataFrame:
    return N.boilerplate_labels(_corpus(spark, base)).groupBy("label").agg(F.count("*").alias("n"))


def boilerplate_uniqueness(spark: SparkSession, base: str) -> DataFrame:
    return N.uniqueness(_corpus(spark, base)).where("others > 0").withColumnRenamed("no", "sentence_index")


def _pairs(spark: SparkSession, base: str) -> DataFrame:
    return N.pair_sentences(section_pairs(spark, base), 30)


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select("section_id", F.col("no").alias("sentence_index"), F.md5("text_a").alias("a"), F.md5("text_b").alias("b"), "label")


def train_tier1_exact(spark: SparkSession, base: str) -> DataFrame:
    return _hashed(N.tier_exact(_pairs(spark, base)))


def train_tier2_overlap(spark: SparkSession, base: str) -> DataFrame:
    return _hashed(N.tier_overlap(_pairs(spark, base)))


def train_tier4_pairs(spark: SparkSession, base: str) -> DataFrame:
    return N.tier_across(_corpus(spark, base)).select(F.md5("norm").alias("sentence_hash"), "company_a", "company_b", F.md5("text_b").alias("b"), "companies", "label")


def _by_section(spark: SparkSession, base: str) -> DataFrame:
    s = clean_sections(spark, base, "section_text").where("section_text is not null")
    sents = s.select("company_id", "section", "section_id", F.posexplode(T.sentences(F.col("section_text"))).alias("no", "sentence")).where(F.length("sentence") >= 30)
    return sents.withColumn("norm", N.normal(F.col("sentence")))


def train_tier3_cross(spark: SparkSession, base: str) -> DataFrame:
    c = N.tier_cross(_by_section(spark, base))
    return c.select("company_id", "section_a", "section_b", F.md5("text_a").alias("a"), F.md5("text_b").alias("b"), "label")


def train_tier5_critical(spark: SparkSession, base: str) -> DataFrame:
    return _hashed(N.tier_critical(_pairs(spark, base), SAMPLE_TIERS["critical"]))


def train_label_bands(spark: SparkSession, base: str) -> DataFrame:
    return N.label_bands(table(spark, base, "sentence_changes", "id", "change_type", "sentence_text", "matched_text", "similarity_score"))


def train_negatives(spark: SparkSession, base: str) -> DataFrame:
    return N.negatives(table(spark, base, "sentence_changes", "id", "drift_score_id", "change_type"), 66)


def data_quality_report(spark: SparkSession, base: str) -> DataFrame:
    p = _pairs(spark, base)
    return N.quality_report(N.tier_exact(p).select("text_a", "label").unionAll(N.tier_overlap(p).select("text_a", "label")).unionAll(N.tier_critical(p, SAMPLE_TIERS["critical"]).select("text_a", "label")))


def train_budget(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of all five tiers within their budgets: exact, overlapping, cross-section, cross-company, critical."""
    p = _pairs(spark, base)
    tiers = {1: N.tier_exact(p), 2: N.tier_overlap(p), 3: N.tier_cross(_by_section(spark, base)), 4: N.tier_across(_corpus(spark, base)), 5: N.tier_critical(p, SAMPLE_TIERS["critical"])}
    b = N.budgeted(tiers, 400, {1: 0.30, 2: 0.20, 3: 0.25, 4: 0.15, 5: 0.10})
    return b.select("tier", F.md5("text_a").alias("a"), F.md5("text_b").alias("b"), "label")


def train_outcomes(spark: SparkSession, base: str) -> DataFrame:
    """Pairs anchored in outcomes: none, for there are no prices."""
    return N.outcome_pairs(spark, None)


def train_split(spark: SparkSession, base: str) -> DataFrame:
    c = N.hash_split(table(spark, base, "sentence_changes", "id", "change_type"), "id")
    return c.groupBy(F.lower("change_type").alias("label"), "held_out").agg(F.count("*").alias("n"))


def rolling_sentences(spark: SparkSession, base: str) -> DataFrame:
    r = N.rolling_index(table(spark, base, "sentence_changes", "id", "sentence_text"), "id")
    return r.select("id", F.md5("sentence_text").alias("sentence_hash"))


def risk_classifier(spark: SparkSession, base: str) -> DataFrame:
    """Held-out levels of changed sentences by a perceptron 384 -> 128 -> 4 on their words, trained on the labels that their terms give."""
    c = table(spark, base, "sentence_changes", "id", "sentence_text")
    rows = stored(M.stratified(M.encoded(c, "id", "sentence_text").join(risk_labels(spark, base), "id"), "id", "label"))
    model = M.trained(rows.where("not held_out"), 4)
    got = M.classified_risk(model, rows.where("held_out"), "id").join(rows.select("id", "risk_level"), "id")
    return got.groupBy("risk_level").agg(F.count("*").alias("n"), F.round(F.avg((F.col("level") == F.col("risk_level")).cast("double")), 4).alias("accuracy"), F.round(F.avg("score"), 4).alias("mean_score"))


def boilerplate_classifier(spark: SparkSession, base: str) -> DataFrame:
    """Held-out labels of sentences by a perceptron 384 -> 64 -> 2: said by three companies or more, or by one."""
    s = stored(_corpus(spark, base))
    labelled = N.boilerplate_labels(s).select("norm", "label")
    rows = stored(M.stratified(M.encoded(labelled, "norm", "norm").join(labelled, "norm"), "norm", "label"))
    model = M.trained(rows.where("not held_out"), 2, 64, rounds=30)
    got = M.boilerplate_share(rows.where("held_out"), "norm", model).join(rows.select("norm", "label"), "norm")
    return got.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("boilerplate"), 4).alias("mean_boilerplate"))


def marginal_keyphrases(spark: SparkSession, base: str) -> DataFrame:
    """Ten phrases of each section that say most about it and least about each other."""
    s = table(spark, base, "sections", "id", "section_text").where("section_text is not null")
    return s.select(F.col("id").alias("section_id"), F.posexplode(M.keyphrases(F.col("section_text"))).alias("no", "x")).select("section_id", (F.col("no") + 1).alias("rank"), "x.phrase", "x.score")


QUERIES = {
    f.__name__: f
    for f in (
        lexicon_from_wide, sentiment_contextual, pair_sentiment_delta, sentence_risk_tiers, risk_summary, sentence_exact_changes, sentence_similarity, sentence_alignment, head_tail_truncate,
        boilerplate_sentences, boilerplate_labels, boilerplate_uniqueness, train_tier1_exact, train_tier2_overlap, train_tier4_pairs, train_tier3_cross, train_tier5_critical, train_outcomes, risk_filtered, risk_entries, risk_labels, train_label_bands, train_negatives, data_quality_report, train_budget, train_split, rolling_sentences, risk_classifier, boilerplate_classifier, marginal_keyphrases,
    )
}

_LEX_ROWS = values_sql([(w, c) for w, cs in SAMPLE_SENTIMENT.items() for c in cs])
_LEX = f"lx AS (SELECT * FROM (VALUES {_LEX_ROWS}) v(word, category))"
_MARKS = f"list_filter(w[greatest(pos - 5, 1) : pos - 1], lambda t: t IN {words_sql(NEGATIONS + SCOPE_BREAKERS)})"
_HITS = f"ht AS (SELECT k, w, pos, w[pos] AS word FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS pos FROM sw)), hc AS (SELECT k, CASE WHEN pos > 1 AND len({_MARKS}) > 0 AND list_last({_MARKS}) IN {words_sql(NEGATIONS)} THEN CASE category WHEN 'negative' THEN 'positive' WHEN 'positive' THEN 'negative' END ELSE category END AS category FROM ht JOIN lx USING (word)), hn AS (SELECT k, " + ", ".join(f"count_if(category = '{c}') AS {c}" for c in CATEGORIES) + " FROM hc GROUP BY k)"


def _senti(rows: str, key: str, text: str, split: bool = True) -> str:
    """CTEs ending in ``sn``: shares of each category by key."""
    sw = f"sw AS (SELECT k, {tok_sql('s')} AS w FROM (SELECT {key} AS k, unnest({sent_sql(text)}) AS s FROM {rows} WHERE {text} IS NOT NULL))" if split else f"sw AS (SELECT {key} AS k, {tok_sql(text)} AS w FROM {rows} WHERE {text} IS NOT NULL)"
    share = ", ".join(f"coalesce(coalesce({c}, 0) / nullif(n, 0)::DOUBLE, 0.0) AS {c}" for c in CATEGORIES)
    return f"{sw}, {_HITS}, tn AS (SELECT {key} AS k, len({tok_sql(text)}) AS n FROM {rows} WHERE {text} IS NOT NULL), sn AS (SELECT tn.k, {share} FROM tn LEFT JOIN hn ON hn.k = tn.k)"


def _any(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(sentence_text), '{t}')" for t in terms) + ")"


_TI = f"{_LEX}, {_senti('sentence_changes', 'id', 'sentence_text', False)}, ti AS (SELECT id, {', '.join(f'{_any(v)} AS is_{k}' for k, v in SAMPLE_TIERS.items())}, negative AS neg, uncertainty AS unc, litigious AS lit FROM sentence_changes JOIN sn ON sn.k = id), tr AS (SELECT id, CASE WHEN is_boilerplate AND NOT is_critical AND NOT is_high THEN 'boilerplate' WHEN is_critical THEN 'critical' WHEN is_high THEN 'high' WHEN is_medium THEN 'medium' WHEN neg + 0.5::DOUBLE * unc + 0.5::DOUBLE * lit > 0.08 THEN 'medium' ELSE 'low' END AS level, CASE WHEN is_boilerplate AND NOT is_critical AND NOT is_high THEN 0.05::DOUBLE WHEN is_critical THEN 0.95::DOUBLE WHEN is_high THEN CASE WHEN neg > 0.05 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END WHEN is_medium THEN CASE WHEN neg > 0.05 THEN 0.55::DOUBLE ELSE 0.45::DOUBLE END WHEN neg + 0.5::DOUBLE * unc + 0.5::DOUBLE * lit > 0.08 THEN 0.35::DOUBLE ELSE 0.1::DOUBLE END AS score FROM ti)"


def _trunc(x: str, most: int = 300) -> str:
    return f"CASE WHEN len({x}) > {most} THEN list_concat({x}[1:{most // 2}], {x}[len({x}) - {most // 2 - 1}:]) ELSE {x} END"


_PA = f"p0 AS (SELECT section_id, 0 AS side, {sent_sql('prev_text')} AS s FROM pr UNION ALL SELECT section_id, 1, {sent_sql('text')} FROM pr), p1 AS (SELECT section_id, side, {_trunc('s')} AS s FROM p0), ps AS (SELECT section_id, side, no - 1 AS no, s[no] AS sentence FROM (SELECT section_id, side, s, unnest(range(1, len(s) + 1)) AS no FROM p1))"
#: The same with whole texts: only alignment and similarity cut them.
_PS = _PA.replace(_trunc("s") + " AS s", "s")
_NORM = f"lower({strip_sql('sentence')})"
_SIM = f"wt AS (SELECT section_id, side, no, unnest({tok_sql('sentence')}) AS token FROM ps), wc AS (SELECT section_id, side, no, token, count(*) AS n FROM wt GROUP BY ALL), wq AS (SELECT section_id, side, no, sum(n * n) AS q FROM wc GROUP BY ALL), wj AS (SELECT * FROM wc JOIN wq USING (section_id, side, no)), eg AS (SELECT a.section_id, a.no AS i, b.no AS j, round(sum(a.n * b.n) / sqrt((any_value(a.q) * any_value(b.q))::DOUBLE), 6) AS sim FROM wj a JOIN wj b ON a.section_id = b.section_id AND a.token = b.token AND a.side = 0 AND b.side = 1 GROUP BY ALL)"


def _fold(name: str, edges: str) -> str:
    return (
        f"{name}0 AS (SELECT section_id, list({{'d': -sim, 'i': i, 'j': j}} ORDER BY -sim, i, j) AS e FROM {edges} GROUP BY section_id), "
        f"{name}1 AS (SELECT section_id, list_reduce(list_transform(e, lambda x: {{'a': [x.i], 'b': [x.j], 'm': [x]}}), lambda acc, x: CASE WHEN list_contains(acc.a, x.a[1]) OR list_contains(acc.b, x.b[1]) THEN acc ELSE {{'a': list_concat(acc.a, x.a), 'b': list_concat(acc.b, x.b), 'm': list_concat(acc.m, x.m)}} END).m AS m FROM {name}0), "
        f"{name} AS (SELECT section_id, x.i AS i, x.j AS j, -x.d AS sim FROM (SELECT section_id, unnest(m) AS x FROM {name}1))"
    )


_CO = f"co AS (SELECT company_id, section_id, filing_date, no - 1 AS no, s[no] AS sentence, lower({strip_sql('s[no]')}) AS norm FROM (SELECT *, unnest(range(1, len(s) + 1)) AS no FROM (SELECT company_id, section_id, filing_date, {sent_sql('section_text')} AS s FROM cs WHERE section_text IS NOT NULL)) WHERE length(s[no]) >= 30)"
_PL = _PS + f", pl AS (SELECT *, {_NORM} AS norm FROM ps WHERE length(sentence) >= 30)"
_T1 = "t1 AS (SELECT a.section_id, a.no, a.sentence AS text_a, b.text_b, 1.0::DOUBLE AS label FROM pl a JOIN (SELECT section_id, norm, min_by(sentence, no) AS text_b FROM pl WHERE side = 1 GROUP BY ALL) b USING (section_id, norm) WHERE a.side = 0)"
_T2 = f"tw AS (SELECT *, list_distinct({tok_sql('sentence')}) AS w FROM pl), t2 AS (SELECT a.section_id, a.no, a.sentence AS text_a, b.sentence AS text_b, len(list_intersect(a.w, b.w)) / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0)::DOUBLE AS label FROM tw a JOIN tw b ON a.section_id = b.section_id AND a.side = 0 AND b.side = 1 WHERE NOT EXISTS (SELECT 1 FROM pl c WHERE c.section_id = a.section_id AND c.side = 1 AND c.norm = a.norm) AND label >= 0.8 QUALIFY row_number() OVER (PARTITION BY a.section_id, a.no ORDER BY label DESC, b.no) = 1), t3 AS (SELECT section_id, no, text_a, text_b, round(label, 4) AS label FROM t2)"
_T4 = "o AS (SELECT norm, company_id, min_by(sentence, (section_id, no)) AS sentence FROM co GROUP BY ALL), h AS (SELECT norm, min(company_id) AS company_a, min_by(sentence, company_id) AS text_a, count(*) AS companies FROM o GROUP BY ALL HAVING count(*) >= 3), t4 AS (SELECT norm, company_a, company_id AS company_b, text_a, sentence AS text_b, companies, 0.9::DOUBLE AS label FROM o JOIN h USING (norm) WHERE company_id > company_a)"
_CX = f"cx AS (SELECT company_id, section, section_id, no - 1 AS no, s[no] AS sentence, lower({strip_sql('s[no]')}) AS norm FROM (SELECT *, unnest(range(1, len(s) + 1)) AS no FROM (SELECT company_id, section, section_id, {sent_sql('section_text')} AS s FROM cs WHERE section_text IS NOT NULL)) WHERE length(s[no]) >= 30)"
_T3 = "xo AS (SELECT company_id, section, norm, min_by(sentence, (section_id, no)) AS sentence FROM cx GROUP BY ALL), xn AS (SELECT *, row_number() OVER (PARTITION BY company_id, section ORDER BY md5('42:' || norm), norm) AS rn FROM xo QUALIFY rn <= 33), tx AS (SELECT a.company_id, section_a, section_b, a.sentence AS text_a, b.sentence AS text_b, 0.0::DOUBLE AS label FROM (VALUES " + values_sql(N.CROSS_SECTIONS) + ") v(section_a, section_b) JOIN xn a ON a.section = section_a JOIN xn b ON b.section = section_b AND b.company_id = a.company_id AND b.rn = a.rn)"
_T5 = "ec AS (SELECT * FROM pl a WHERE NOT EXISTS (SELECT 1 FROM pl b WHERE b.section_id = a.section_id AND b.side = 1 - a.side AND b.norm = a.norm)), eg5 AS (SELECT section_id, sentence, row_number() OVER (PARTITION BY section_id ORDER BY md5('42:' || sentence), no) - 1 AS rn, count(*) OVER (PARTITION BY section_id) AS k FROM ec WHERE side = 0), en5 AS (SELECT section_id, no, sentence, row_number() OVER (PARTITION BY section_id ORDER BY no) - 1 AS n FROM ec WHERE side = 1 AND (" + " OR ".join(f"contains(lower(sentence), '{x}')" for x in SAMPLE_TIERS["critical"]) + ")), t5 AS (SELECT en5.section_id, en5.no, en5.sentence AS text_a, eg5.sentence AS text_b, 0.0::DOUBLE AS label FROM en5 JOIN eg5 ON eg5.section_id = en5.section_id AND eg5.rn = en5.n % eg5.k)"
_HASHED = "SELECT section_id, no::INT AS sentence_index, md5(text_a) AS a, md5(text_b) AS b, label FROM "

SQL = {
    "lexicon_from_wide": f"SELECT word, category FROM (VALUES {_LEX_ROWS}, ('late', 'litigious')) v(word, category)",
    "sentiment_contextual": f"WITH {_LEX}, {_senti('documents', 'doc_id', 'text')} SELECT k AS doc_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in CATEGORIES) + " FROM sn",
    "pair_sentiment_delta": f"WITH {P_SQL}, {_LEX}, bo AS (SELECT section_id * 2 AS k2, prev_text AS t FROM pr UNION ALL SELECT section_id * 2 + 1, text FROM pr), {_senti('bo', 'k2', 't')} SELECT a.k // 2 AS section_id, " + ", ".join(f"round(b.{c} - a.{c}, 6) AS {c}" for c in CATEGORIES) + " FROM sn a JOIN sn b ON b.k = a.k + 1 WHERE a.k % 2 = 0",
    "sentence_risk_tiers": f"WITH {_TI} SELECT * FROM tr",
    "risk_summary": f"WITH {_TI} SELECT drift_score_id, max(score) AS max_score, count_if(score >= 0.9)::BIGINT AS critical, count_if(score >= 0.6 AND score < 0.9)::BIGINT AS high, count(*) AS n, CASE WHEN max(score) >= 0.9 THEN 'critical' WHEN max(score) >= 0.6 THEN 'high' WHEN max(score) >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM tr JOIN sentence_changes USING (id) GROUP BY drift_score_id",
    "sentence_exact_changes": f"WITH {P_SQL}, {_PS}, pn AS (SELECT *, {_NORM} AS norm FROM ps) SELECT section_id, CASE side WHEN 1 THEN 'added' ELSE 'removed' END AS change, no::INT AS sentence_index, md5(sentence) AS sentence_hash FROM pn a WHERE NOT EXISTS (SELECT 1 FROM pn b WHERE b.section_id = a.section_id AND b.side = 1 - a.side AND b.norm = a.norm)",
    "sentence_similarity": f"WITH {P_SQL}, {_PA}, {_SIM} SELECT section_id, i::INT AS i, j::INT AS j, sim FROM eg WHERE sim >= 0.55",
    "sentence_alignment": f"WITH {P_SQL}, {_PA}, {_SIM}, e1 AS (SELECT * FROM eg WHERE sim >= 0.55), {_fold('ma', 'e1')}, e2 AS (SELECT * FROM eg WHERE sim >= 0.25 AND NOT EXISTS (SELECT 1 FROM ma WHERE ma.section_id = eg.section_id AND ma.i = eg.i) AND NOT EXISTS (SELECT 1 FROM ma WHERE ma.section_id = eg.section_id AND ma.j = eg.j)), {_fold('mb', 'e2')}, nn AS (SELECT section_id, count_if(side = 0)::BIGINT AS n_prev, count_if(side = 1)::BIGINT AS n_curr FROM ps GROUP BY ALL), cc AS (SELECT section_id, count_if(sim >= 0.85)::BIGINT AS unchanged, count_if(sim < 0.85)::BIGINT AS changed FROM ma GROUP BY ALL), rr AS (SELECT section_id, count(*) AS replacements FROM mb GROUP BY ALL), al AS (SELECT section_id, n_prev, n_curr, coalesce(unchanged, 0) AS unchanged, coalesce(changed, 0) AS changed, coalesce(replacements, 0) AS replacements FROM nn LEFT JOIN cc USING (section_id) LEFT JOIN rr USING (section_id)) SELECT *, n_curr - unchanged - changed AS added, n_prev - unchanged - changed AS removed FROM al",
    "head_tail_truncate": f"WITH s AS (SELECT doc_id, {sent_sql('text')} AS s FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, {_trunc('s', 6)} AS s FROM s) SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS kept FROM t",
    "boilerplate_sentences": f"WITH {S_SQL}, {_CO} SELECT md5(norm) AS sentence_hash, count(DISTINCT company_id) AS companies, count(*) AS n, md5(min_by(sentence, (filing_date, section_id, no))) AS first_hash FROM co GROUP BY norm HAVING count(DISTINCT company_id) >= 3",
    "boilerplate_labels": f"WITH {S_SQL}, {_CO}, k AS (SELECT norm, count(DISTINCT company_id) AS k FROM co GROUP BY ALL) SELECT CASE WHEN k >= 3 THEN 1 ELSE 0 END AS label, count(*) AS n FROM k WHERE k <> 2 GROUP BY 1",
    "boilerplate_uniqueness": f"WITH {S_SQL}, {_CO}, k AS (SELECT norm, count(DISTINCT company_id) - 1 AS others FROM co GROUP BY ALL) SELECT section_id, no::INT AS sentence_index, others, round(greatest(0.0, 1 - others / 10.0::DOUBLE), 4) AS uniqueness, others >= 3 AS is_boilerplate FROM co JOIN k USING (norm) WHERE others > 0",
    "train_tier1_exact": f"WITH {P_SQL}, {_PL}, {_T1} {_HASHED} t1",
    "train_tier2_overlap": f"WITH {P_SQL}, {_PL}, {_T2} {_HASHED} t3",
    "train_tier4_pairs": f"WITH {S_SQL}, {_CO}, {_T4} SELECT md5(norm) AS sentence_hash, company_a, company_b, md5(text_b) AS b, companies, label FROM t4",
    "train_tier3_cross": f"WITH {S_SQL}, {_CX}, {_T3} SELECT company_id, section_a, section_b, md5(text_a) AS a, md5(text_b) AS b, label FROM tx",
    "train_tier5_critical": f"WITH {P_SQL}, {_PL}, {_T5} {_HASHED} t5",
    "train_outcomes": "SELECT 1 AS id, 'a' AS text_a, 'b' AS text_b, 0.0::DOUBLE AS label WHERE false",
    "risk_filtered": f"WITH {_TI}, kn AS (SELECT c.id, c.drift_score_id, company_id, {_NORM.replace('sentence', 'sentence_text')} AS norm FROM sentence_changes c JOIN drift_scores d ON d.id = c.drift_score_id), ko AS (SELECT norm, count(DISTINCT company_id) - 1 AS others FROM kn GROUP BY ALL), kf AS (SELECT sentence_changes.drift_score_id, CASE WHEN coalesce(others, 0) >= 3 THEN 0.05::DOUBLE ELSE score END AS score FROM tr JOIN sentence_changes USING (id) LEFT JOIN kn ON kn.id = tr.id LEFT JOIN ko USING (norm)) SELECT drift_score_id, max(score) AS max_score, count_if(score >= 0.9)::BIGINT AS critical, count_if(score >= 0.6 AND score < 0.9)::BIGINT AS high, count_if(score <= 0.05)::BIGINT AS boilerplate_filtered, count_if(score > 0.05)::BIGINT AS substantive, CASE WHEN max(score) >= 0.9 THEN 'critical' WHEN max(score) >= 0.6 THEN 'high' WHEN max(score) >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM kf GROUP BY drift_score_id",
    "risk_entries": f"WITH {_TI} SELECT drift_score_id, id, level, score, row_number() OVER (PARTITION BY drift_score_id ORDER BY score DESC, id)::INT AS rank, substring(sentence_text, 1, 120) AS excerpt FROM tr JOIN sentence_changes USING (id)",
    "risk_labels": f"WITH {_TI} SELECT id, CASE level WHEN 'boilerplate' THEN 'low' ELSE level END AS risk_level, CASE level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS label, score FROM tr JOIN sentence_changes USING (id) WHERE length(trim(sentence_text)) >= 20",
    "train_label_bands": "SELECT id, round(CASE WHEN similarity_score >= 0.8 THEN similarity_score ELSE (similarity_score - 0.55::DOUBLE) / 0.25::DOUBLE * 0.65::DOUBLE END, 6) AS label, CASE WHEN similarity_score >= 0.8 THEN 'positive' ELSE 'soft' END AS band FROM sentence_changes WHERE lower(change_type) = 'changed' AND matched_text IS NOT NULL AND length(trim(sentence_text)) >= 20 AND similarity_score >= 0.55",
    "train_negatives": "WITH n AS (SELECT id, drift_score_id, lower(change_type) AS kind, row_number() OVER (PARTITION BY drift_score_id, lower(change_type) ORDER BY md5('42:' || id), id) AS rn FROM sentence_changes WHERE lower(change_type) IN ('added', 'removed')) SELECT a.drift_score_id, a.id AS added_id, b.id AS removed_id FROM n a JOIN n b ON a.drift_score_id = b.drift_score_id AND a.rn = b.rn AND a.kind = 'added' AND b.kind = 'removed' WHERE a.rn <= 66",
    "data_quality_report": f"WITH {P_SQL}, {_PL}, {_T1}, {_T2}, {_T5}, q AS (SELECT text_a, label FROM t1 UNION ALL SELECT text_a, label FROM t3 UNION ALL SELECT text_a, label FROM t5) SELECT count(*) AS n, round(avg(label), 6) AS mean_label, round(stddev_pop(label), 6) AS std_label, min(label) AS min_label, max(label) AS max_label, round(avg(length(text_a)), 6) AS mean_chars, round(avg(len({tok_sql('text_a')})), 6) AS mean_tokens, count_if(label >= 0.5)::BIGINT AS positive, count_if(label < 0.5)::BIGINT AS negative, round(coalesce(count_if(label >= 0.5) / nullif(count_if(label < 0.5), 0)::DOUBLE, 'inf'::DOUBLE), 6) AS pos_neg_ratio, (SELECT count(DISTINCT t) FROM (SELECT unnest({tok_sql('text_a')}) AS t FROM q)) AS distinct_tokens FROM q",
    "train_budget": f"WITH {P_SQL}, {_PL}, {_T1}, {_T2}, {_CO}, {_T4}, {_CX}, {_T3}, {_T5}, a0 AS (SELECT 1 AS tier, text_a, text_b, label FROM t1 UNION ALL SELECT 2, text_a, text_b, label FROM t3 UNION ALL SELECT 3, text_a, text_b, label FROM tx UNION ALL SELECT 4, text_a, text_b, label FROM t4 UNION ALL SELECT 5, text_a, text_b, label FROM t5), al AS (SELECT tier, text_a, text_b, label FROM a0 QUALIFY row_number() OVER (PARTITION BY tier, lower({strip_sql('text_a')}), lower({strip_sql('text_b')}) ORDER BY text_a, text_b, label) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5('42|' || text_a || '|' || text_b), text_a, text_b) AS rn FROM al) SELECT tier, md5(text_a) AS a, md5(text_b) AS b, label FROM r WHERE rn <= CASE tier WHEN 1 THEN 120 WHEN 2 THEN 80 WHEN 3 THEN 100 WHEN 4 THEN 60 ELSE 40 END",
    "train_split": "SELECT lower(change_type) AS label, ('0x' || substring(md5(id::VARCHAR), 1, 8))::BIGINT % 5 = 0 AS held_out, count(*) AS n FROM sentence_changes GROUP BY ALL",
    "rolling_sentences": "SELECT id, md5(sentence_text) AS sentence_hash FROM sentence_changes ORDER BY id DESC LIMIT 50000",
}
