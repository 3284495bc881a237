"""Queries on texts: drift, information, readability, phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.lexicons import HEDGE_WORDS, SAMPLE_SOFT, SAMPLE_WATCH, STOP_WORDS
from tidemark.operators import lexical as L
from tidemark.plans.views import P_SQL, S_SQL, clean_sections, naive_sql, section_pairs, sent_sql, strip_sql, tok_sql, values_sql, words_sql
from tidemark.session import stored
from tidemark.sources.tables import table


def pair_jaccard_drift(spark: SparkSession, base: str) -> DataFrame:
    return L.jaccard_drift(section_pairs(spark, base))


def doc_tokens_stats(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents", "doc_id", "text").where("text is not null").withColumn("w", T.tokens(F.col("text")))
    w = F.col("w")
    return d.select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_distinct"), T.word_count(F.col("text")).alias("word_count"), F.length("text").alias("n_chars"))


def doc_sentence_stats(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents", "doc_id", "text").where("text is not null").withColumn("s", T.sentences(F.col("text")))
    s = F.col("s")
    return d.select("doc_id", F.size(s).alias("n_sentences"), F.size(T.naive_sentences(F.col("text"))).alias("n_naive"), F.size(F.filter(s, lambda x: F.length(x) >= 30)).alias("n_long"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).alias("longest"))


def doc_entropy(spark: SparkSession, base: str) -> DataFrame:
    return L.entropy(L.word_counts(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id")


def pair_information(spark: SparkSession, base: str) -> DataFrame:
    return L.information_change(section_pairs(spark, base))


def pair_top_novel_tokens(spark: SparkSession, base: str) -> DataFrame:
    return L.novel_tokens(section_pairs(spark, base))


def doc_readability(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("w"), T.naive_sentences(F.col("text")).alias("s"))
    m = T.readability(F.col("w"), F.col("s"))
    return d.select("doc_id", F.round(m["density"], 4).alias("density"), F.round(m["fog"], 4).alias("fog"), F.round(m["coleman"], 4).alias("coleman"))


def doc_specificity(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", F.round(L.specificity(F.col("text"), T.tokens(F.col("text"))), 6).alias("specificity"))


def pair_euphemisms(spark: SparkSession, base: str) -> DataFrame:
    return L.softened(section_pairs(spark, base), SAMPLE_SOFT)


def pair_obfuscation(spark: SparkSession, base: str) -> DataFrame:
    return L.obfuscation(section_pairs(spark, base), SAMPLE_SOFT)


def _counts(spark: SparkSession, base: str) -> DataFrame:
    return L.ngram_counts(clean_sections(spark, base, "section_text").where("section_text is not null"), "section_id", "section_text")


def ngram_tf(spark: SparkSession, base: str) -> DataFrame:
    return _counts(spark, base).groupBy("phrase").agg(F.sum("n").alias("n"), F.count("*").alias("n_sections")).where("n >= 20")


def corpus_df(spark: SparkSession, base: str) -> DataFrame:
    """Document frequency over the sections of 100 words or more."""
    s = clean_sections(spark, base, "section_text", "word_count").where("section_text is not null and word_count >= 100")
    return L.document_frequency(L.ngram_counts(s, "section_id", "section_text")).where("df >= 2")


def _tops(spark: SparkSession, base: str) -> DataFrame:
    counts = stored(_counts(spark, base))  # read twice
    n = clean_sections(spark, base, "section_text").where("section_text is not null").count()
    return L.tfidf_top(counts, "section_id", L.document_frequency(counts), n)


def tfidf_topk(spark: SparkSession, base: str) -> DataFrame:
    return _tops(spark, base)


def pair_keyphrase_diff(spark: SparkSession, base: str) -> DataFrame:
    return L.phrase_changes(section_pairs(spark, base), stored(_tops(spark, base)))  # read for both sides


def watch_phrase_changes(spark: SparkSession, base: str) -> DataFrame:
    return L.watch_changes(section_pairs(spark, base), SAMPLE_WATCH[:5], SAMPLE_WATCH[4:])


def chunk_windows(spark: SparkSession, base: str) -> DataFrame:
    return L.chunk_windows(table(spark, base, "sections", "id", "section_text"), "id", "section_text").withColumnRenamed("id", "section_id")


def long_sections(spark: SparkSession, base: str) -> DataFrame:
    """Sections whose stored word count is off, against a count of their text."""
    s = table(spark, base, "sections", "id", "section_text", "word_count").where("section_text is not null")
    n = T.word_count(F.col("section_text"))
    return s.select(F.col("id").alias("section_id"), "word_count", n.alias("counted")).where("word_count is null or word_count <> counted")


QUERIES = {
    f.__name__: f
    for f in (pair_jaccard_drift, doc_tokens_stats, doc_sentence_stats, doc_entropy, pair_information, pair_top_novel_tokens, doc_readability, doc_specificity, pair_euphemisms, pair_obfuscation, ngram_tf, corpus_df, tfidf_topk, pair_keyphrase_diff, watch_phrase_changes, chunk_windows, long_sections)
}

_STOP = words_sql(STOP_WORDS)
_WORDS_OF = "list_filter(string_split(regexp_replace({x}, '[\\s\\x0b\\x85\\p{{Z}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_SYL = "greatest(len(regexp_extract_all(w, '[aeiouy]+')), 1) - CASE WHEN ends_with(w, 'e') AND greatest(len(regexp_extract_all(w, '[aeiouy]+')), 1) > 1 THEN 1 ELSE 0 END"
_NGRAM = "list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))"


def _read_sql(x: str) -> str:
    """w: words, s: sentences of ``x``."""
    return f"{tok_sql(x)} AS w, {naive_sql(x)} AS s"


_DENS = "CASE WHEN len(w) = 0 OR len(s) = 0 THEN 0.0 ELSE len(list_distinct(w)) / len(s)::DOUBLE END"
_FOG = f"CASE WHEN len(w) = 0 OR len(s) = 0 THEN 0.0 ELSE 0.4::DOUBLE * (len(w) / len(s)::DOUBLE + 100 * (len(list_filter(w, lambda w: {_SYL} >= 3)) / len(w)::DOUBLE)) END"
_COL = "CASE WHEN len(w) = 0 OR len(s) = 0 THEN 0.0 ELSE 0.0588::DOUBLE * (100 * (list_sum(list_transform(w, lambda x: length(x))) / len(w)::DOUBLE)) - 0.296::DOUBLE * (100 * (len(s) / len(w)::DOUBLE)) - 15.8::DOUBLE END"
_DATE_SQL = L.DATE.replace("(?iU)", "", 1)
_US = r"[\s\x0b]"


def _spec_sql(x: str) -> str:
    hedge = f"len(list_filter({tok_sql(x)}, lambda t: t IN {words_sql(HEDGE_WORDS)}))"
    date, entity = _DATE_SQL.replace("\\s", _US), L.ENTITY.replace("(?U)", "", 1).replace("\\s", _US)
    # word boundaries know ASCII only here: other letters become "_", other blanks " ", other signs "#"
    plain = f"regexp_replace(regexp_replace(regexp_replace({x}, '[\\p{{Z}}\\x85]', ' ', 'g'), '[^\\x00-\\x7F\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]', '#', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
    concrete = f"(len(regexp_extract_all({x}, '{T.NUMBER}')) + len(regexp_extract_all({plain}, '(?i){date}')) + len(regexp_extract_all({plain}, '{entity}')))"
    return f"CASE WHEN {concrete} + {hedge} = 0 THEN 0.5 ELSE {concrete} / ({concrete} + {hedge})::DOUBLE END"


_SOFT_ROWS = values_sql([(t, s, L._soft_gap(t, s)) for t, softs in SAMPLE_SOFT.items() for s in softs])
_SOFT_SQL = f"so AS (SELECT section_id, term, soft, gap FROM pr, (VALUES {_SOFT_ROWS}) x(term, soft, gap) WHERE contains(lower(prev_text), term) AND NOT contains(lower(text), term) AND NOT contains(lower(prev_text), soft) AND contains(lower(text), soft))"
_DIST = f"""tk AS (SELECT section_id, 0 AS side, unnest({tok_sql('prev_text')}) AS token FROM pr UNION ALL SELECT section_id, 1, unnest({tok_sql('text')}) FROM pr),
di AS (SELECT section_id, token, count_if(side = 0) AS p, count_if(side = 1) AS q FROM tk WHERE token NOT IN {_STOP} GROUP BY ALL)"""
_CNT = f"wd AS (SELECT section_id, {tok_sql('section_text')} AS w FROM cs WHERE section_text IS NOT NULL), ng AS (SELECT section_id, unnest({_NGRAM}) AS phrase FROM wd), cn AS (SELECT section_id, phrase, count(*) AS n FROM ng GROUP BY ALL)"
_TOP = _CNT + """, dfq AS (SELECT phrase, count(*) AS df FROM cn GROUP BY ALL), tt AS (SELECT section_id, sum(n) AS total FROM cn GROUP BY ALL),
sc AS (SELECT section_id, phrase, round(n / total::DOUBLE * ln(greatest((SELECT count(*) FROM wd), 1)::DOUBLE / (1 + df)), 6) AS score FROM cn JOIN tt USING (section_id) JOIN dfq USING (phrase)),
tp AS (SELECT section_id, row_number() OVER (PARTITION BY section_id ORDER BY score DESC, phrase) AS rank, phrase, score FROM sc QUALIFY rank <= 20)"""

SQL = {
    "pair_jaccard_drift": f"""WITH {P_SQL}, w AS (SELECT company_id, section, section_id, prev_id, list_distinct({tok_sql('prev_text')}) AS a, list_distinct({tok_sql('text')}) AS b FROM pr)
SELECT company_id, section, section_id, prev_id, round(1 - CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 6) AS jaccard_distance,
  (len(b) - len(list_intersect(a, b)))::INT AS added_words, (len(a) - len(list_intersect(a, b)))::INT AS removed_words FROM w""",
    "doc_tokens_stats": f"WITH w AS (SELECT doc_id, text, {tok_sql('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(w)::INT AS n_tokens, len(list_distinct(w))::INT AS n_distinct, len({_WORDS_OF.format(x='text')})::INT AS word_count, length(text)::INT AS n_chars FROM w",
    "doc_sentence_stats": f"WITH w AS (SELECT doc_id, {sent_sql('text')} AS s, {naive_sql('text')} AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(s)::INT AS n_sentences, len(n)::INT AS n_naive, len(list_filter(s, lambda x: length(x) >= 30))::INT AS n_long, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS longest FROM w",
    "doc_entropy": f"WITH t AS (SELECT doc_id, unnest({tok_sql('text')}) AS token FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS n_tokens, count(*) AS n_distinct, round(log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n), 4) AS entropy FROM c GROUP BY doc_id",
    "pair_information": f"""WITH {P_SQL}, {_DIST}, t AS (SELECT section_id, sum(p) AS np, sum(q) AS nq, count(*) AS v FROM di GROUP BY ALL),
j AS (SELECT section_id, np, nq, v, p AS cp, q AS cq, p / nullif(np, 0)::DOUBLE AS p, q / nullif(nq, 0)::DOUBLE AS q, CASE WHEN di.p > 0 THEN di.p / np::DOUBLE ELSE 1 / (100.0::DOUBLE * v) END AS pf, CASE WHEN di.q > 0 THEN di.q / nq::DOUBLE ELSE 1 / (100.0::DOUBLE * v) END AS qf FROM di JOIN t USING (section_id)),
r AS (SELECT section_id, any_value(np) AS np, any_value(nq) AS nq, any_value(v) AS v, sum(CASE WHEN cp > 0 THEN -p * log2(p) ELSE 0 END) AS hp, sum(CASE WHEN cq > 0 THEN -q * log2(q) ELSE 0 END) AS hq, sum(CASE WHEN cp > 0 THEN -p * log2(qf) ELSE 0 END) AS ce, sum(CASE WHEN cq > 0 THEN q * log2(q / pf) ELSE 0 END) AS kl, count_if(cp = 0) AS uc, count_if(cq = 0) AS up FROM j GROUP BY section_id),
e AS (SELECT *, CASE WHEN np = 0 OR nq = 0 THEN 0.0 ELSE ce END AS c2, CASE WHEN np = 0 OR nq = 0 THEN 0.0 ELSE greatest(0.0, kl) END AS k2, CASE WHEN np = 0 OR nq = 0 THEN 0.0 ELSE greatest(0.0, ce - hp) END AS cond FROM r)
SELECT section_id, round(hp, 4) AS entropy_prev, round(hq, 4) AS entropy_curr, round(CASE WHEN hp > 0 THEN (hq - hp) / hp WHEN hq = 0 THEN 0.0 ELSE 1.0 END, 4) AS entropy_change, round(c2, 4) AS cross_entropy, round(cond, 4) AS conditional_entropy, round(k2, 4) AS kl_divergence,
  round(greatest(0.0, least(1.0, 0.40::DOUBLE * least(1.0, k2 / 3) + 0.35::DOUBLE * least(1.0, cond / 5) + 0.25::DOUBLE * coalesce(uc / nullif(v - up, 0)::DOUBLE, 0))), 4) AS novelty, round((v - uc - up) / v::DOUBLE, 4) AS vocabulary_overlap, uc::BIGINT AS unique_to_curr, up::BIGINT AS unique_to_prev FROM e""",
    "pair_top_novel_tokens": f"WITH {P_SQL}, {_DIST} SELECT section_id, row_number() OVER (PARTITION BY section_id ORDER BY q DESC, token)::INT AS rank, token, q::BIGINT AS n FROM di WHERE p = 0 AND q > 0 QUALIFY rank <= 20",
    "doc_readability": f"WITH r AS (SELECT doc_id, {_read_sql('text')} FROM documents WHERE text IS NOT NULL) SELECT doc_id, round({_DENS}, 4) AS density, round({_FOG}, 4) AS fog, round({_COL}, 4) AS coleman FROM r",
    "doc_specificity": f"SELECT doc_id, round({_spec_sql('text')}, 6) AS specificity FROM documents WHERE text IS NOT NULL",
    "pair_euphemisms": f"WITH {P_SQL}, {_SOFT_SQL} SELECT section_id, term, soft, gap::DOUBLE AS gap FROM so",
    "pair_obfuscation": f"""WITH {P_SQL}, {_SOFT_SQL}, sg AS (SELECT section_id, count(*) AS n, avg(gap::DOUBLE) AS gap FROM so GROUP BY ALL),
x AS (SELECT section_id, 0 AS side, {_read_sql('prev_text')}, {_spec_sql('prev_text')} AS sp FROM pr UNION ALL SELECT section_id, 1, {_read_sql('text')}, {_spec_sql('text')} FROM pr),
m AS (SELECT section_id, side, {_DENS} AS d, {_FOG} AS f, {_COL} AS c, sp::DOUBLE AS sp FROM x),
b AS (SELECT p.section_id, CASE WHEN p.d > 0 THEN (q.d - p.d) / p.d ELSE 0.0 END AS dc, q.sp - p.sp AS sc, ((q.f - p.f) / greatest(p.f, 1.0) + (q.c - p.c) / greatest(abs(p.c), 1.0)) / 2 AS rc FROM m p JOIN m q USING (section_id) WHERE p.side = 0 AND q.side = 1),
g AS (SELECT section_id, round(greatest(0.0, least(1.0, -dc / 0.40::DOUBLE)), 4) AS density_signal, round(greatest(0.0, least(1.0, -sc / 0.30::DOUBLE)), 4) AS specificity_signal, round(greatest(0.0, least(1.0, rc / 0.20::DOUBLE)), 4) AS readability_signal, round(CASE WHEN n > 0 THEN least(1.0, n * 0.25::DOUBLE + gap) ELSE 0.0 END, 4) AS euphemism_signal FROM b LEFT JOIN sg USING (section_id))
SELECT *, round(greatest(0.0, least(1.0, 0.25::DOUBLE * density_signal + 0.30::DOUBLE * specificity_signal + 0.25::DOUBLE * readability_signal + 0.20::DOUBLE * euphemism_signal)), 6) AS obfuscation FROM g""",
    "ngram_tf": f"WITH {S_SQL}, {_CNT} SELECT phrase, sum(n)::BIGINT AS n, count(*) AS n_sections FROM cn GROUP BY phrase HAVING sum(n) >= 20",
    "corpus_df": f"WITH {S_SQL}, lg AS (SELECT cs.* FROM cs JOIN sections s ON s.id = cs.section_id WHERE s.word_count >= 100 AND cs.section_text IS NOT NULL), wd AS (SELECT section_id, {tok_sql('section_text')} AS w FROM lg), ng AS (SELECT DISTINCT section_id, unnest({_NGRAM}) AS phrase FROM wd) SELECT phrase, count(*) AS df FROM ng GROUP BY phrase HAVING count(*) >= 2",
    "tfidf_topk": f"WITH {S_SQL}, {_TOP} SELECT section_id, rank::INT AS rank, phrase, score FROM tp",
    "pair_keyphrase_diff": f"""WITH {P_SQL}, {_TOP}, cu AS (SELECT pr.section_id, phrase AS cp, score AS cs FROM pr JOIN tp USING (section_id)), pv AS (SELECT pr.section_id, phrase AS pp, score AS ps FROM pr JOIN tp ON tp.section_id = pr.prev_id),
x AS (SELECT *, len(list_intersect(string_split(cp, ' '), string_split(pp, ' '))) / len(list_distinct(list_concat(string_split(cp, ' '), string_split(pp, ' '))))::DOUBLE AS ov FROM cu JOIN pv USING (section_id)),
ne AS (SELECT section_id, cp, cs, pp, ps FROM x WHERE ov >= 0.6 QUALIFY row_number() OVER (PARTITION BY section_id, cp ORDER BY ov DESC, pp) = 1), ex AS (SELECT section_id, cp, cs, pp, ps FROM x WHERE cp = pp),
ma AS (SELECT * FROM ex UNION ALL SELECT * FROM ne WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.section_id = ne.section_id AND ex.cp = ne.cp)), po AS (SELECT section_id, pp FROM ex UNION SELECT section_id, pp FROM ne)
SELECT section_id, CASE WHEN cs > ps * 1.1::DOUBLE THEN 'intensified' ELSE 'diminished' END AS status, cp AS phrase, pp AS prev_phrase, ps AS prev_score, cs AS curr_score FROM ma WHERE cs > ps * 1.1::DOUBLE OR cs < ps * 0.9::DOUBLE
UNION ALL SELECT section_id, 'appeared', cp, NULL, NULL, cs FROM cu WHERE NOT EXISTS (SELECT 1 FROM ma WHERE ma.section_id = cu.section_id AND ma.cp = cu.cp)
UNION ALL SELECT section_id, 'disappeared', pp, NULL, ps, NULL FROM pv WHERE NOT EXISTS (SELECT 1 FROM po WHERE po.section_id = pv.section_id AND po.pp = pv.pp)""",
    "watch_phrase_changes": f"WITH {P_SQL}, w AS (SELECT section_id, phrase, contains(lower(prev_text), phrase) AS a, contains(lower(text), phrase) AS b FROM pr, (VALUES {values_sql([(p,) for p in sorted(set(SAMPLE_WATCH))])}) v(phrase)) SELECT section_id, phrase, CASE WHEN a AND b THEN 'persisted' WHEN b THEN 'appeared' ELSE 'disappeared' END AS status FROM w WHERE a OR b",
    "chunk_windows": f"WITH c AS (SELECT id AS section_id, section_text AS t, unnest(range(0, CASE WHEN length(section_text) <= 2000 THEN 1 ELSE (length(section_text) - 1) // 1600 + 1 END)) AS chunk FROM sections WHERE section_text IS NOT NULL AND {strip_sql('section_text')} <> ''), p AS (SELECT section_id, chunk, substring(t, chunk * 1600 + 1, 2000) AS piece FROM c) SELECT section_id, chunk::INT AS chunk, length(piece)::INT AS chunk_chars FROM p WHERE {strip_sql('piece')} <> ''",
    "long_sections": f"WITH c AS (SELECT id AS section_id, word_count, len({_WORDS_OF.format(x='section_text')})::INT AS counted FROM sections WHERE section_text IS NOT NULL) SELECT * FROM c WHERE word_count IS NULL OR word_count <> counted",
}
