"""Queries on drift series, patterns and composite risk."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lexicons import CRITICAL_TERMS, SAMPLE_TIERS, SAMPLE_WATCH
from tidemark.operators import intelligence as I
from tidemark.operators import series as S
from tidemark.operators.sentences import has_any
from tidemark.plans.relational import _PREV
from tidemark.operators.lexical import watch_changes
from tidemark.operators.medians import medians
from tidemark.plans.views import D_SQL, F_SQL, P_SQL, S_SQL, clean_drift, clean_filings, clean_sections, section_pairs, values_sql
from tidemark.session import stored
from tidemark.sources.tables import table


#: The fixed critical terms and those of the project's texts.
CRITICAL = [*CRITICAL_TERMS, *SAMPLE_TIERS["critical"]]


def _base(spark: SparkSession, base: str) -> DataFrame:
    return S.base(clean_drift(spark, base))


def _sectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "companies", "id", "sic_code").select(F.col("id").alias("company_id"), F.substring("sic_code", 1, 2).alias("sector"))


def _tidy(c: str, d: int = 6) -> Column:
    """Rounded unless huge, where the digits after the point mean nothing."""
    return F.when(F.abs(c) < 1e6, F.round(c, d)).otherwise(F.col(c)).alias(c)


def anomaly_company(spark: SparkSession, base: str) -> DataFrame:
    a = S.company_anomaly(_base(spark, base))
    return a.select("company_id", "section", "filing_id", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("z", 4).alias("z"), "level")


def anomaly_sector(spark: SparkSession, base: str) -> DataFrame:
    """Latest values against the latest ones of five or more peers in sector and section; level from both z-scores."""
    a = S.company_anomaly(_base(spark, base)).where("r = 1").select("company_id", "section", "cosine", "z")
    j = S.leave_one_out(a.join(_sectors(spark, base).where("sector is not null"), "company_id"), ["sector", "section"], "cosine")
    sz = F.when(F.col("peers") >= 5, S.zscore(F.col("cosine"), F.col("peer_mean"), F.col("peer_std")))
    return j.select("company_id", "section", "peers", F.round(sz, 4).alias("sector_z"), S.level(F.col("z"), sz, F.col("cosine")).alias("level"))


def trend_signals(spark: SparkSession, base: str) -> DataFrame:
    return S.trends(_base(spark, base))


def kinematics_derivatives(spark: SparkSession, base: str) -> DataFrame:
    return S.derivatives(_base(spark, base)).select("company_id", "section", "filing_id", _tidy("velocity"), _tidy("acceleration", 4), _tidy("jerk", 3))


def kinematics_momentum(spark: SparkSession, base: str) -> DataFrame:
    return S.momentum(S.derivatives(_base(spark, base))).select("company_id", "section", _tidy("momentum", 5))


def kinematics_phase(spark: SparkSession, base: str) -> DataFrame:
    k = S.kinematics(_base(spark, base))
    return k.select("company_id", "section", "points", _tidy("velocity"), _tidy("mean_velocity", 5), _tidy("max_velocity", 5), "phase")


def increasing_streaks(spark: SparkSession, base: str) -> DataFrame:
    return S.streaks(_base(spark, base))


def peer_patterns(spark: SparkSession, base: str) -> DataFrame:
    """For each rising series up to ten others of its section that rise as well, by id."""
    from pyspark.sql import Window

    s = S.streaks(_base(spark, base))
    # positions in the section's order: the ten before and after are all that can be listed
    w = Window.partitionBy("section").orderBy("company_id")
    n = s.withColumn("no", F.row_number().over(w))
    near = n.select("section", F.col("company_id").alias("other_id"), F.col("no").alias("o")).where("o <= 11")
    j = n.join(near, "section").where("company_id <> other_id").where("case when no <= 10 then o <= 11 else o <= 10 end")
    return j.select("company_id", "section", "other_id")


def obfuscation_wave(spark: SparkSession, base: str) -> DataFrame:
    return S.obfuscation_wave(_base(spark, base))


def sentiment_reversal(spark: SparkSession, base: str) -> DataFrame:
    return S.reversal(_base(spark, base))


def _changes(spark: SparkSession, base: str, kind: str) -> DataFrame:
    c = table(spark, base, "sentence_changes", "drift_score_id", "change_type").where(F.lower("change_type") == kind)
    d = table(spark, base, "drift_scores", "id", "filing_id").select(F.col("id").alias("drift_score_id"), "filing_id")
    return c.join(d, "drift_score_id").join(clean_filings(spark, base).select("filing_id", "company_id", "filing_date"), "filing_id").select("company_id", "filing_date")


def explosion(spark: SparkSession, base: str) -> DataFrame:
    return S.explosion(_changes(spark, base, "added"))


def silent_deletion(spark: SparkSession, base: str) -> DataFrame:
    return S.silent_deletion(_changes(spark, base, "removed"))


def peer_divergence(spark: SparkSession, base: str) -> DataFrame:
    return S.peer_divergence(_base(spark, base), _sectors(spark, base))


def market_divergence(spark: SparkSession, base: str) -> DataFrame:
    return S.market_divergence(_base(spark, base))


def leave_one_out(spark: SparkSession, base: str) -> DataFrame:
    d = clean_drift(spark, base).where("cosine is not null").select("id", "section", "form", "cosine")
    return S.leave_one_out(d, ["section", "form"], "cosine").select("id", "peers", F.round("peer_mean", 9).alias("peer_mean"), F.round("peer_std", 9).alias("peer_std"))


def sector_trends(spark: SparkSession, base: str) -> DataFrame:
    return S.sector_trends(clean_drift(spark, base), table(spark, base, "companies", "id", "sic_code"))


def sector_trends_wide(spark: SparkSession, base: str) -> DataFrame:
    """The same for divisions, the first digit of the code, from two companies on."""
    c = table(spark, base, "companies", "id", "sic_code").withColumn("sic_code", F.substring("sic_code", 1, 1))
    return S.sector_trends(clean_drift(spark, base), c, 2)


def peer_divergence_mild(spark: SparkSession, base: str) -> DataFrame:
    return S.peer_divergence(_base(spark, base), _sectors(spark, base), 0.5)


def market_divergence_mild(spark: SparkSession, base: str) -> DataFrame:
    return S.market_divergence(_base(spark, base), 1.0)


def phrase_propagation(spark: SparkSession, base: str) -> DataFrame:
    """Watched phrases spreading through the companies' stored sections."""
    s = clean_sections(spark, base, "section_text").where("section_text is not null")
    words = F.broadcast(spark.createDataFrame([(p,) for p in SAMPLE_WATCH], "phrase string"))  # a list of fixed size
    seen = s.join(words, F.contains(F.lower("section_text"), F.col("phrase"))).select("phrase", "company_id", F.col("filing_date").alias("seen_date"))
    return S.propagation(seen)


def _phrase_counts(spark: SparkSession, base: str) -> DataFrame:
    """New sentences of each company's latest day of changes, and how many hold a critical term."""
    c = table(spark, base, "sentence_changes", "drift_score_id", "change_type", "sentence_text").where("lower(change_type) = 'added'")
    d = table(spark, base, "drift_scores", "id", "company_id", "filing_id").select(F.col("id").alias("drift_score_id"), "company_id", "filing_id")
    j = c.join(d, "drift_score_id").join(clean_filings(spark, base).select("filing_id", "filing_date"), "filing_id")
    top = j.join(j.groupBy("company_id").agg(F.max("filing_date").alias("filing_date")), ["company_id", "filing_date"])
    return top.groupBy("company_id").agg(F.count("*").alias("n_new"), F.count_if(has_any(F.lower("sentence_text"), CRITICAL)).alias("n_critical"))


def _alert_counts(spark: SparkSession, base: str) -> DataFrame:
    return clean_drift(spark, base).where("cosine > 0.35").groupBy("company_id").agg(F.count("*").alias("n_alerts"))


def _scores(spark: SparkSession, base: str) -> DataFrame:
    return I.risk_scores(_base(spark, base), _phrase_counts(spark, base), _alert_counts(spark, base))


def risk_score_components(spark: SparkSession, base: str) -> DataFrame:
    return _scores(spark, base)


def risk_levels(spark: SparkSession, base: str) -> DataFrame:
    return _scores(spark, base).groupBy("risk_level").agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 4).alias("mean_score"))


def _phrase_moves(spark: SparkSession, base: str) -> DataFrame:
    """(company_id, phrase, status) of watched phrases between each section and its predecessor: the fixed words of concern and those of the project's texts."""
    p = section_pairs(spark, base)
    return watch_changes(p, [*S.CONCERN, *SAMPLE_WATCH]).join(p.select("section_id", "company_id"), "section_id")


def _patterns(spark: SparkSession, base: str) -> DataFrame:
    """The best score of each company in each of seven patterns."""
    s = stored(_base(spark, base))  # read by five of them
    found = {
        "lazy_prices": S.streaks(s), "going_concern": S.going_concern(s, _phrase_moves(spark, base), [*S.CONCERN, *SAMPLE_WATCH[:2]]), "obfuscation_wave": S.obfuscation_wave(s), "explosion": S.explosion(_changes(spark, base, "added")),
        "sentiment_reversal": S.reversal(s), "silent_deletion": S.silent_deletion(_changes(spark, base, "removed")), "peer_divergence": S.peer_divergence(s, _sectors(spark, base)),
    }
    out = None
    for name, rows in found.items():
        one = rows.groupBy("company_id").agg(F.max("score").alias("score")).select("company_id", F.lit(name).alias("pattern"), "score")
        out = one if out is None else out.unionAll(one)
    return out


def going_concern(spark: SparkSession, base: str) -> DataFrame:
    return S.going_concern(_base(spark, base), _phrase_moves(spark, base), [*S.CONCERN, *SAMPLE_WATCH[:2]])


def pattern_scores(spark: SparkSession, base: str) -> DataFrame:
    return _patterns(spark, base).select("company_id", "pattern", F.round("score", 4).alias("score"))


def findings(spark: SparkSession, base: str) -> DataFrame:
    return I.findings(_scores(spark, base), _patterns(spark, base))


def predictions(spark: SparkSession, base: str) -> DataFrame:
    s, p = _scores(spark, base), _patterns(spark, base)
    return I.predictions(s, p, I.findings(s, p))


def comparables(spark: SparkSession, base: str) -> DataFrame:
    s = _base(spark, base)
    latest = s.join(s.groupBy("company_id").agg(F.max("filing_date").alias("filing_date")), ["company_id", "filing_date"]).groupBy("company_id").agg(F.avg("cosine").alias("drift"))
    return I.comparables(latest, _sectors(spark, base))


def overview(spark: SparkSession, base: str) -> DataFrame:
    """Latest value, anomaly, phase and trends of each series in one row."""
    s = _base(spark, base)
    a = S.company_anomaly(s).where("r = 1").select("company_id", "section", "filing_id", F.when(F.col("cosine") != 0, F.round("cosine", 4)).alias("cosine"), F.round("z", 4).alias("z"), "level")
    k = S.kinematics(s).select("company_id", "section", "phase")
    t = S.trends(s).select("company_id", "section", (F.col("drift_acceleration") | F.col("drift_spike") | F.col("elevated_baseline") | F.col("sentiment_deterioration") | F.col("uncertainty_increasing")).alias("has_trend"))
    return a.join(k, ["company_id", "section"], "left").join(t, ["company_id", "section"], "left")


def _labels(spark: SparkSession, base: str) -> DataFrame:
    label = F.coalesce(F.nullif(F.col("ticker"), F.lit("")), F.concat(F.lit("CID-"), "id"))
    return table(spark, base, "companies", "id", "ticker").select(F.col("id").alias("company_id"), label.alias("label"))


def headlines(spark: SparkSession, base: str) -> DataFrame:
    """A line of text and the tone of each company, of fixed templates: its risk and the most severe finding."""
    s = stored(_scores(spark, base))
    return I.headlines(s, I.findings(s, _patterns(spark, base)), _labels(spark, base))


def actions(spark: SparkSession, base: str) -> DataFrame:
    """What to do about each company, in order."""
    s, p = stored(_scores(spark, base)), stored(_patterns(spark, base))
    return I.actions(s, I.findings(s, p), p)


def intelligence(spark: SparkSession, base: str) -> DataFrame:
    """One row for each company: score, level, headline, and the numbers of findings, predictions, actions and comparables."""
    s, p = stored(_scores(spark, base)), stored(_patterns(spark, base))
    found = I.findings(s, p)
    parts = {"findings": found, "predictions": I.predictions(s, p, found), "actions": I.actions(s, found, p), "comparables": comparables(spark, base)}
    out = s.select("company_id", "risk_score", "risk_level").join(I.headlines(s, found, _labels(spark, base)).select("company_id", "headline"), "company_id")
    for name, rows in parts.items():
        out = out.join(rows.groupBy("company_id").agg(F.count("*").alias(f"n_{name}")), "company_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def market_report(spark: SparkSession, base: str) -> DataFrame:
    """Mean drift of the market and the number of signals of each kind."""
    level = clean_drift(spark, base).agg(F.round(F.coalesce(F.avg("cosine"), F.lit(0.0)), 6).alias("value")).select(F.lit("market_drift").alias("metric"), "value")
    kinds = {"sector_trend": sector_trends(spark, base), "divergence": market_divergence(spark, base), "propagation": phrase_propagation(spark, base)}
    for kind, rows in kinds.items():
        level = level.unionAll(rows.agg(F.count("*").cast("double").alias("value")).select(F.lit(kind).alias("metric"), "value"))
    return level


def percentile_thresholds(spark: SparkSession, base: str) -> DataFrame:
    d = stored(clean_drift(spark, base).where("cosine is not null").select("section", "cosine"))
    out = None
    for p in (0.2, 0.5, 0.75, 0.9):
        one = medians(d, ["section"], "cosine", "v", p).select("section", F.round("v", 9).alias(f"p{int(p * 100)}"))
        out = one if out is None else out.join(one, "section")
    return out


def backtest_metrics(spark: SparkSession, base: str) -> DataFrame:
    return I.backtest(clean_drift(spark, base), clean_filings(spark, base))


def label_histogram(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "sentence_changes", "similarity_score").where("similarity_score is not null")
    return c.groupBy(F.least(F.floor(F.col("similarity_score") * 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def linear_extrapolation(spark: SparkSession, base: str) -> DataFrame:
    """Least squares line of each series and its value one step ahead, from plain sums."""
    s = _base(spark, base).where("n >= 3").groupBy("company_id", "section").agg(F.count("*").alias("k"), F.sum("i").alias("si"), F.sum(F.col("i") * F.col("i")).alias("sii"), F.sum("cosine").alias("sy"), F.sum(F.col("i") * F.col("cosine")).alias("siy"))
    c = F.col
    slope = (c("k") * c("siy") - c("si") * c("sy")) / (c("k") * c("sii") - c("si") * c("si"))
    s = s.withColumn("slope", slope).withColumn("next", (c("sy") - slope * c("si")) / c("k") + slope * (c("k") + 1))
    return s.select("company_id", "section", F.round("slope", 9).alias("slope"), F.round("next", 9).alias("next"))


QUERIES = {
    f.__name__: f
    for f in (
        anomaly_company, anomaly_sector, trend_signals, kinematics_derivatives, kinematics_momentum, kinematics_phase, increasing_streaks, peer_patterns, obfuscation_wave, going_concern, sentiment_reversal, explosion, silent_deletion,
        peer_divergence, market_divergence, peer_divergence_mild, market_divergence_mild, leave_one_out, sector_trends, sector_trends_wide, phrase_propagation, risk_score_components, risk_levels, pattern_scores, findings, predictions, comparables, overview, headlines, actions, intelligence, market_report,
        percentile_thresholds, backtest_metrics, label_histogram, linear_extrapolation,
    )
}

_J = "TRY_CAST(CASE WHEN json_valid(sentiment_delta) THEN sentiment_delta ->> '$.{k}' END AS DOUBLE)"
_W = "PARTITION BY company_id, section ORDER BY filing_date, filing_id"
_SE = D_SQL + f", se AS (SELECT company_id, section, filing_id, filing_date, cosine, {_J.format(k='negative')} AS neg, {_J.format(k='positive')} AS pos, {_J.format(k='uncertainty')} AS unc, row_number() OVER ({_W}) AS i, row_number() OVER (PARTITION BY company_id, section ORDER BY filing_date DESC, filing_id DESC) AS r, count(*) OVER (PARTITION BY company_id, section) AS n FROM dr WHERE cosine IS NOT NULL)"
_SEC = "sx AS (SELECT id AS company_id, substring(sic_code, 1, 2) AS sector FROM companies)"


def _level(z: str, sz: str, v: str) -> str:
    own = f"CASE WHEN {z} > 3.0 THEN 3 WHEN {z} > 2.0 THEN 2 WHEN {z} > 1.4 THEN 1 ELSE 0 END"
    code = f"CASE WHEN {z} IS NULL AND {sz} IS NULL THEN CASE WHEN {v} > 0.3 THEN 2 WHEN {v} > 0.2 THEN 1 ELSE 0 END WHEN {sz} > 2.5 AND {own} IN (0, 1) THEN {own} + 1 ELSE {own} END"
    return f"['normal', 'elevated', 'high', 'extreme'][{code} + 1]"


_CA = f"ca0 AS (SELECT *, avg(cosine) OVER b AS m0, stddev_pop(cosine) OVER b AS s0, count(*) OVER b AS k0 FROM se WINDOW b AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), ca AS (SELECT *, CASE WHEN k0 >= 3 THEN m0 END AS mean, CASE WHEN k0 >= 3 THEN s0 END AS std, CASE WHEN k0 >= 3 AND s0 >= 0.001 THEN (cosine - m0) / s0 END AS z FROM ca0)"


def _loo(rows: str, group: str, value: str) -> str:
    """Peers by a self join: the plain way to say it."""
    return f"(SELECT a.*, x.peers, x.peer_mean, x.peer_std FROM {rows} a LEFT JOIN LATERAL (SELECT count(*) AS peers, avg(b.{value}) AS peer_mean, stddev_pop(b.{value}) AS peer_std FROM {rows} b WHERE " + " AND ".join(f"b.{g} = a.{g}" for g in group.split(",")) + " AND b.id <> a.id) x ON true)"


_T4 = ", ".join(f"max(CASE WHEN r = {k} THEN cosine END) AS c{k}, max(CASE WHEN i = {k} THEN cosine END) AS e{k}, max(CASE WHEN r = {k} THEN coalesce(neg, 0) END) AS neg{k}, max(CASE WHEN r = {k} THEN coalesce(unc, 0) END) AS unc{k}" for k in (1, 2, 3, 4))
_RISE = "{a}4 <= {a}3 AND {a}3 <= {a}2 AND {a}2 <= {a}1 AND {a}1 > {a}4"
_TR = f"tg AS (SELECT company_id, section, max(n) AS periods, {_T4} FROM se GROUP BY ALL HAVING max(n) >= 4), tr AS (SELECT company_id, section, periods, c4 < c3 AND c3 < c2 AND c2 < c1 AS drift_acceleration, (c2 + c3 + c4) / 3 > 0 AND c1 > (c2 + c3 + c4) / 3 * 2 AS drift_spike, periods >= 8 AND (e1 + e2 + e3 + e4) / 4 > 0 AND (c1 + c2 + c3 + c4) / 4 > (e1 + e2 + e3 + e4) / 4 * 1.5::DOUBLE AS elevated_baseline, {_RISE.format(a='neg')} AS sentiment_deterioration, {_RISE.format(a='unc')} AS uncertainty_increasing FROM tg)"
_GAP = "datediff('day', lag(filing_date) OVER w, filing_date) / 365.25::DOUBLE"
_KD = f"k1 AS (SELECT *, CASE WHEN {_GAP} = 0 THEN 1e-6::DOUBLE ELSE {_GAP} END AS dt, lag(cosine) OVER w AS pc FROM se WINDOW w AS ({_W})), k2 AS (SELECT *, (cosine - pc) / dt AS velocity FROM k1), k3 AS (SELECT *, (lag(dt) OVER w + dt) / 2 AS da, lag(velocity) OVER w AS pv FROM k2 WINDOW w AS ({_W})), k4 AS (SELECT *, (velocity - pv) / da AS acceleration FROM k3), kd AS (SELECT *, (acceleration - lag(acceleration) OVER w) / ((lag(da) OVER w + da) / 2) AS jerk FROM k4 WINDOW w AS ({_W}))"
_ALPHA = 1 - math.exp(-math.log(2) / 3)
_KM = f"km AS (SELECT company_id, section, list_reduce(list(velocity ORDER BY filing_date, filing_id), lambda a, v: {_ALPHA!r}::DOUBLE * v + {1 - _ALPHA!r}::DOUBLE * a) AS momentum FROM kd WHERE velocity IS NOT NULL GROUP BY ALL)"
_PH = "CASE WHEN abs(jerk) > 0.015 AND abs(acceleration) > 0.01 THEN 'regime_change' WHEN abs(jerk) > 0.005 OR std_velocity > 0.05 THEN 'volatile' WHEN acceleration > 0.01 THEN 'accelerating' WHEN acceleration < -0.01 THEN 'decelerating' WHEN abs(velocity) > 0.01 THEN 'drifting' ELSE 'stable' END"
_KI = f"kg AS (SELECT company_id, section, max(n) AS points, " + ", ".join(f"coalesce(max(CASE WHEN r = 1 THEN {c} END), 0.0) AS {c}" for c in ("velocity", "acceleration", "jerk")) + f", avg(velocity) AS mean_velocity, stddev_pop(velocity) AS std_velocity, max(abs(velocity)) AS max_velocity FROM kd GROUP BY ALL HAVING max(n) >= 2), ki AS (SELECT *, {_PH} AS phase FROM kg)"


def _tidy_sql(c: str, d: int = 6) -> str:
    return f"CASE WHEN abs({c}) < 1e6 THEN round({c}, {d}) ELSE {c} END AS {c}"


_ST = f"sf AS (SELECT *, CASE WHEN cosine > lag(cosine) OVER ({_W}) THEN NULL ELSE r END AS falls FROM se), sk AS (SELECT company_id, section, min(falls) AS streak, round(least(min(falls) / 6.0::DOUBLE, 1.0), 3) AS score FROM sf GROUP BY ALL HAVING min(falls) >= 3)"
_RV = "rk AS (SELECT company_id, section, pos, row_number() OVER (PARTITION BY company_id, section ORDER BY filing_date DESC, filing_id DESC) AS r FROM se WHERE pos IS NOT NULL), rg AS (SELECT company_id, section, max(CASE WHEN r = 2 THEN pos END) AS before, max(CASE WHEN r = 1 THEN pos END) AS now FROM rk GROUP BY ALL), rv AS (SELECT company_id, section, before, now, round(least(1 - now / before, 1.0), 4) AS score FROM rg WHERE before > 0.01 AND now < 0.5::DOUBLE * before)"
_EV = "ev AS (SELECT f.company_id, f.filing_date, lower(c.change_type) AS kind, c.sentence_text FROM sentence_changes c JOIN drift_scores d ON d.id = c.drift_score_id JOIN f ON f.filing_id = d.filing_id)"
_EX = "xd AS (SELECT company_id, filing_date, count(*) AS k, row_number() OVER (PARTITION BY company_id ORDER BY filing_date DESC) AS r FROM ev WHERE kind = 'added' GROUP BY company_id, filing_date), xg AS (SELECT company_id, max(CASE WHEN r = 1 THEN k END) AS latest, avg(CASE WHEN r > 1 THEN k END) AS baseline FROM xd GROUP BY ALL), ex AS (SELECT company_id, latest, round(baseline, 6) AS baseline, round(least(latest / (baseline * 4), 1.0), 6) AS score FROM xg WHERE baseline > 0 AND latest >= 2 * baseline)"
_LT = "lt AS (SELECT company_id AS id, company_id, avg(cosine) AS drift FROM se QUALIFY false), l2 AS (SELECT s.company_id AS id, s.company_id, avg(s.cosine) AS drift FROM se s JOIN (SELECT company_id, max(filing_date) AS m FROM se GROUP BY ALL) x ON x.company_id = s.company_id AND x.m = s.filing_date GROUP BY s.company_id)".replace("lt AS (SELECT company_id AS id, company_id, avg(cosine) AS drift FROM se QUALIFY false), ", "")
_MDS = "md AS (SELECT *, CASE WHEN peer_std >= 0.001 THEN (drift - peer_mean) / peer_std END AS z FROM " + _loo("(SELECT *, 1 AS one FROM l2)", "one", "drift") + " q WHERE peers >= 2), mv AS (SELECT company_id, round(drift, 6) AS drift, round(z, 4) AS z, CASE WHEN z > 0 THEN 'UP' ELSE 'DOWN' END AS direction, round(least(abs(z) / 5, 1.0), 3) AS significance FROM md WHERE abs(z) > {limit})"
_MD = _MDS.replace("{limit}", "2.0")
_SQW = "sq AS (SELECT coalesce(nullif(substring(sic_code, 1, 1), ''), 'unknown') AS sector, year(filing_date) || '-Q' || quarter(filing_date) AS quarter, company_id, avg(cosine) AS m FROM dr JOIN companies c ON c.id = dr.company_id WHERE cosine IS NOT NULL GROUP BY ALL), so AS (SELECT sector, quarter, dense_rank() OVER (PARTITION BY sector ORDER BY quarter) AS no FROM (SELECT DISTINCT sector, quarter FROM sq)), sn AS (SELECT * FROM sq JOIN so USING (sector, quarter)), ss AS (SELECT a.sector, a.quarter, count(*) AS companies, round(avg(a.m - b.m) + 1e-11::DOUBLE, 6) AS rise, round(least(1.0, avg(a.m - b.m) * 10), 3) AS significance FROM sn a JOIN sn b ON a.sector = b.sector AND a.company_id = b.company_id AND b.no = a.no - 1 WHERE a.m > b.m GROUP BY ALL HAVING count(*) >= 2)"
_SQ = _SQW.replace("substring(sic_code, 1, 1)", "sic_code").replace("HAVING count(*) >= 2", "HAVING count(*) >= 3")
_PP = "pa AS (SELECT phrase, company_id, min(filing_date) AS d FROM cs, (VALUES " + values_sql([(p,) for p in SAMPLE_WATCH]) + ") v(phrase) WHERE contains(lower(section_text), phrase) GROUP BY ALL), pm AS (SELECT phrase, company_id AS first_company, d AS first_date FROM pa QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY d, company_id) = 1), pj AS (SELECT phrase, first_company, first_date, greatest(1, round_even(abs(datediff('day', first_date, d)) / 91.0, 0))::INT AS lag FROM pa JOIN pm USING (phrase) WHERE company_id <> first_company), pp AS (SELECT phrase, first_company, first_date, count(*) AS followers, round(avg(lag), 4) AS mean_lag, round(least(1.0, 0.2::DOUBLE * count(*) + 0.3::DOUBLE / avg(lag)), 3) AS significance FROM pj WHERE lag BETWEEN 1 AND 4 GROUP BY ALL)"
_RW = "PARTITION BY company_id ORDER BY filing_date, filing_id, section"
_RK = f"""ry AS (SELECT *, avg(cosine) OVER b AS m0, stddev_pop(cosine) OVER b AS s0, count(*) OVER b AS k0, row_number() OVER (PARTITION BY company_id ORDER BY filing_date DESC, filing_id DESC, section DESC) AS rr FROM se WINDOW b AS ({_RW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rl AS (SELECT company_id, cosine, neg, CASE WHEN k0 >= 3 AND s0 >= 0.001 THEN (cosine - m0) / s0 END AS z FROM ry WHERE rr = 1),
rn AS (SELECT company_id, neg, row_number() OVER (PARTITION BY company_id ORDER BY filing_date DESC, filing_id DESC, section DESC) AS q FROM se WHERE neg IS NOT NULL), rs AS (SELECT company_id, count(*) AS known, max_by(neg, q) AS oldest, min_by(neg, q) AS newest FROM rn WHERE q <= 4 GROUP BY ALL),
rq AS (SELECT company_id, acceleration, phase FROM ki QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY CASE WHEN section = 'risk_factors' THEN 0 ELSE 1 END, section) = 1),
rp AS (SELECT company_id, count(*) AS n_new, count_if(""" + " OR ".join(f"contains(lower(sentence_text), '{x}')" for x in CRITICAL) + """) AS n_critical FROM (SELECT * FROM ev WHERE kind = 'added' QUALIFY filing_date = max(filing_date) OVER (PARTITION BY company_id)) GROUP BY ALL),
ra AS (SELECT company_id, count(*) AS n_alerts FROM dr WHERE cosine > 0.35 GROUP BY ALL),
rc AS (SELECT company_id, phase,
  round(CASE WHEN z > 0 THEN least(z / 4, 1.0) WHEN z IS NULL AND cosine > 0.3 THEN 0.7 WHEN z IS NULL AND cosine > 0.2 THEN 0.4 ELSE 0.0 END, 6) AS anomaly,
  round(greatest(CASE WHEN acceleration > 0 THEN least(acceleration / 0.1::DOUBLE, 1.0) ELSE 0.0 END, CASE phase WHEN 'regime_change' THEN 0.9::DOUBLE WHEN 'accelerating' THEN 0.5::DOUBLE ELSE 0.0 END), 6) AS acceleration,
  round(CASE WHEN known >= 2 AND newest > oldest THEN least((newest - oldest) / 0.1::DOUBLE, 1.0) ELSE 0.0 END, 6) AS sentiment,
  round(CASE WHEN n_critical > 0 THEN least(n_critical / 3.0::DOUBLE, 1.0) WHEN n_new > 10 THEN 0.4::DOUBLE WHEN n_new > 5 THEN 0.2::DOUBLE ELSE 0.0 END, 6) AS phrases,
  round(CASE WHEN cosine > 0.15 AND coalesce(neg, 0.0) < 0.02 THEN least(cosine / 0.3::DOUBLE, 1.0) * 0.6::DOUBLE ELSE 0.0 END, 6) AS obfuscation_proxy,
  round(CASE WHEN cosine > 0.2 THEN least((cosine - 0.1::DOUBLE) / 0.3::DOUBLE, 1.0) ELSE 0.0 END, 6) AS entropy_proxy, round(least(least(coalesce(n_alerts, 0), 10) / 5.0::DOUBLE, 1.0), 6) AS alerts
  FROM rl LEFT JOIN rq USING (company_id) LEFT JOIN rs USING (company_id) LEFT JOIN rp USING (company_id) LEFT JOIN ra USING (company_id)),
rt AS (SELECT *, round(greatest(0.0, least(1.0, 0.0 + anomaly * 0.25::DOUBLE + acceleration * 0.20::DOUBLE + sentiment * 0.15::DOUBLE + phrases * 0.15::DOUBLE + obfuscation_proxy * 0.10::DOUBLE + entropy_proxy * 0.10::DOUBLE + alerts * 0.05::DOUBLE)), 4) AS risk_score FROM rc),
ri AS (SELECT *, CASE """ + " ".join(f"WHEN risk_score >= {v} THEN '{k}'" for v, k in I.LEVELS) + " ELSE 'minimal' END AS risk_level FROM rt)"
_ALL = f"{_SE}, {_KD}, {_KI}, {_EV}, {_RK}"
_WORDS = [*S.CONCERN, *SAMPLE_WATCH[:2]]
_GC = (
    "gp AS (SELECT company_id, count(DISTINCT phrase) AS phrases FROM pr, (VALUES " + values_sql([(p,) for p in _WORDS]) + ") v(phrase) WHERE contains(lower(text), phrase) AND NOT contains(lower(prev_text), phrase) GROUP BY ALL), "
    "gn AS (SELECT company_id, neg, row_number() OVER (PARTITION BY company_id ORDER BY filing_date DESC, filing_id DESC, section DESC) AS q FROM se WHERE neg IS NOT NULL), "
    "gc AS (SELECT company_id, any_value(phrases) AS phrases, coalesce(max(CASE WHEN q = 1 THEN neg END) > max(CASE WHEN q = 2 THEN neg END), false) AS rising FROM gp LEFT JOIN gn USING (company_id) GROUP BY ALL), "
    "gx AS (SELECT company_id, phrases, rising, CASE WHEN rising THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS score FROM gc)"
)
_OWX = f"ow AS (SELECT company_id, section, CASE WHEN cosine < lag(cosine) OVER ({_W}) THEN 1 ELSE 0 END AS fell, abs(coalesce(neg, 0)) AS a FROM se WHERE r <= 4), ox AS (SELECT company_id, section, count(*) AS periods, round(max(a) - min(a), 6) AS range, 0.6::DOUBLE AS score FROM ow GROUP BY ALL HAVING count(*) >= 3 AND sum(fell) = 0 AND max(a) - min(a) < 0.02)"
_SDX = "sd AS (SELECT company_id, filing_date, count(*) AS k FROM ev WHERE kind = 'removed' GROUP BY ALL), sdx AS (SELECT company_id, round(least(max_by(k, filing_date) / 10.0::DOUBLE, 1.0), 3) AS score FROM sd GROUP BY company_id HAVING sum(k) >= 2 AND max_by(k, filing_date) >= 2)"
_PDX = "l3 AS (SELECT l2.*, sector FROM l2 JOIN sx USING (company_id) WHERE sector IS NOT NULL), pd AS (SELECT *, CASE WHEN peer_std >= 0.001 THEN (drift - peer_mean) / peer_std END AS z FROM " + _loo("l3", "sector", "drift") + " q WHERE peers >= 3), pdx AS (SELECT company_id, round(least(z / 4, 1.0), 4) AS score FROM pd WHERE z >= 1.5::DOUBLE)"
_PAIRS = P_SQL.replace(F_SQL + ", ", "")
_PT = f"{_PAIRS}, {_ST}, {_RV}, {_EX}, {_GC}, {_OWX}, {_SDX}, {_SEC}, {_LT}, {_PDX}, pt AS (SELECT company_id, 'lazy_prices' AS pattern, max(score) AS score FROM sk GROUP BY ALL UNION ALL SELECT company_id, 'sentiment_reversal', max(score) FROM rv GROUP BY ALL UNION ALL SELECT company_id, 'explosion', score FROM ex UNION ALL SELECT company_id, 'going_concern', score FROM gx UNION ALL SELECT company_id, 'obfuscation_wave', max(score) FROM ox GROUP BY ALL UNION ALL SELECT company_id, 'silent_deletion', score FROM sdx UNION ALL SELECT company_id, 'peer_divergence', score FROM pdx)"
_FI = """fi AS (SELECT company_id, 'anomaly' AS category, CASE WHEN anomaly >= 0.75 THEN 'critical' WHEN anomaly >= 0.5 THEN 'high' ELSE 'medium' END AS severity FROM ri WHERE anomaly >= 0.4
UNION ALL SELECT company_id, 'kinematics', CASE phase WHEN 'regime_change' THEN 'critical' WHEN 'accelerating' THEN 'high' ELSE 'medium' END FROM ri WHERE phase IN ('regime_change', 'accelerating', 'volatile')
UNION ALL SELECT company_id, 'sentiment', 'high' FROM ri WHERE sentiment > 0.5
UNION ALL SELECT company_id, 'phrases', CASE WHEN phrases IN (0.2, 0.4) THEN 'medium' ELSE 'critical' END FROM ri WHERE phrases > 0
UNION ALL SELECT company_id, 'pattern:' || pattern, CASE WHEN score > 0.6 THEN 'high' ELSE 'medium' END FROM pt)"""
_PR = """p1 AS (SELECT company_id, pattern AS prediction, CASE WHEN pattern = 'going_concern' OR pattern = 'lazy_prices' AND score >= 0.7 THEN 'high' ELSE 'moderate' END AS risk, round(score * CASE pattern WHEN 'lazy_prices' THEN 0.7::DOUBLE WHEN 'going_concern' THEN 0.8::DOUBLE WHEN 'sentiment_reversal' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END, 2) AS confidence FROM pt WHERE pattern IN ('going_concern', 'sentiment_reversal', 'explosion') OR pattern = 'lazy_prices' AND score > 0.5)
SELECT * FROM p1 UNION ALL SELECT company_id, 'overall', 'high', round(risk_score * 0.6::DOUBLE, 2) FROM ri WHERE risk_score >= 0.75 AND company_id NOT IN (SELECT company_id FROM p1 WHERE risk = 'high')
UNION ALL SELECT company_id, 'acceleration', 'moderate', round(risk_score * 0.5::DOUBLE, 2) FROM ri WHERE risk_score >= 0.45 AND risk_score < 0.75 AND company_id IN (SELECT company_id FROM fi WHERE category = 'kinematics')"""

_FT = """ft AS (SELECT company_id, category, severity, row_number() OVER (PARTITION BY company_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, category) AS no FROM fi)"""
_HL = """hl AS (SELECT ri.company_id, coalesce(nullif(ticker, ''), 'CID-' || ri.company_id) || ': ' || upper(risk_level[1]) || risk_level[2:] || ' risk -- ' || coalesce(category, 'no significant findings') AS headline, CASE WHEN sentiment > 0.15 THEN 'sharply more negative' WHEN sentiment > 0.08 THEN 'more negative' ELSE 'little changed' END AS tone FROM ri JOIN companies c ON c.id = ri.company_id LEFT JOIN ft ON ft.company_id = ri.company_id AND no = 1)"""
_AC = """a0 AS (SELECT ri.company_id, no AS pos, 'Immediate review required -- ' || category AS action FROM ri JOIN (SELECT company_id, category, row_number() OVER (PARTITION BY company_id ORDER BY category) AS no FROM fi WHERE severity = 'critical') f USING (company_id) WHERE risk_level = 'critical' AND no <= 3
UNION ALL SELECT company_id, 1, 'Immediate review required -- critical risk score' FROM ri WHERE risk_level = 'critical' AND company_id NOT IN (SELECT company_id FROM fi WHERE severity = 'critical')
UNION ALL SELECT company_id, 0, 'Monitor closely -- elevated risk across multiple signals' FROM ri WHERE risk_level = 'high'
UNION ALL SELECT company_id, no, 'Investigate: ' || category FROM ri JOIN ft USING (company_id) WHERE risk_level = 'high' AND no <= 2 AND severity IN ('critical', 'high')
UNION ALL SELECT company_id, 1, 'Watch for escalation in the next filing period' FROM ri WHERE risk_level IN ('elevated', 'moderate')
UNION ALL SELECT company_id, 1, 'No action needed -- filing within historical norms' FROM ri WHERE risk_level IN ('low', 'minimal')
UNION ALL SELECT company_id, 100 + no, CASE WHEN pattern = 'lazy_prices' THEN 'Review for Lazy Prices signal -- consider position adjustment' ELSE 'Review removed risk phrases for potential concealment' END FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, pattern) AS no FROM pt) q WHERE no <= 2 AND company_id IN (SELECT company_id FROM ri) AND (pattern = 'lazy_prices' AND score > 0.5 OR pattern = 'silent_deletion')),
ac AS (SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY pos) AS no, action FROM a0)"""
_PR0 = _PR.replace("SELECT * FROM p1 UNION ALL", ", px AS (SELECT * FROM p1 UNION ALL", 1).replace("\n, px", ", px") + ")"
_CM = "cm AS (SELECT a.company_id, b.company_id AS other_id, round(greatest(1 - abs(a.drift - b.drift) / greatest(a.drift, b.drift, 0.01), 0.0), 3) AS similarity FROM l2 a JOIN sx p ON p.company_id = a.company_id JOIN sx q ON q.sector = p.sector JOIN l2 b ON b.company_id = q.company_id AND b.company_id <> a.company_id), cx AS (SELECT company_id FROM cm WHERE similarity > 0.5 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY similarity DESC, other_id) <= 5)"

SQL = {
    "anomaly_company": f"WITH {_SE}, {_CA} SELECT company_id, section, filing_id, round(mean, 4) AS mean, round(std, 4) AS std, round(z, 4) AS z, {_level('z', 'NULL', 'cosine')} AS level FROM ca",
    "anomaly_sector": f"WITH {_SE}, {_CA}, {_SEC}, la AS (SELECT company_id AS id, company_id, section, cosine, z, sector FROM ca JOIN sx USING (company_id) WHERE r = 1 AND sector IS NOT NULL), lo AS (SELECT *, CASE WHEN peers >= 5 AND peer_std >= 0.001 THEN (cosine - peer_mean) / peer_std END AS sz FROM {_loo('la', 'sector,section', 'cosine')} q) SELECT company_id, section, peers, round(sz, 4) AS sector_z, {_level('z', 'sz', 'cosine')} AS level FROM lo",
    "trend_signals": f"WITH {_SE}, {_TR} SELECT company_id, section, periods::INT AS periods, drift_acceleration, drift_spike, elevated_baseline, sentiment_deterioration, uncertainty_increasing FROM tr",
    "kinematics_derivatives": f"WITH {_SE}, {_KD} SELECT company_id, section, filing_id, {_tidy_sql('velocity')}, {_tidy_sql('acceleration', 4)}, {_tidy_sql('jerk', 3)} FROM kd",
    "kinematics_momentum": f"WITH {_SE}, {_KD}, {_KM} SELECT company_id, section, {_tidy_sql('momentum', 5)} FROM km",
    "kinematics_phase": f"WITH {_SE}, {_KD}, {_KI} SELECT company_id, section, points::INT AS points, {_tidy_sql('velocity')}, {_tidy_sql('mean_velocity', 5)}, {_tidy_sql('max_velocity', 5)}, phase FROM ki",
    "increasing_streaks": f"WITH {_SE}, {_ST} SELECT company_id, section, streak::INT AS streak, score FROM sk",
    "peer_patterns": f"WITH {_SE}, {_ST} SELECT a.company_id, a.section, b.company_id AS other_id FROM sk a JOIN sk b ON a.section = b.section AND a.company_id <> b.company_id QUALIFY row_number() OVER (PARTITION BY a.company_id, a.section ORDER BY b.company_id) <= 10",
    "obfuscation_wave": f"WITH {_SE}, ow AS (SELECT company_id, section, CASE WHEN cosine < lag(cosine) OVER ({_W}) THEN 1 ELSE 0 END AS fell, abs(coalesce(neg, 0)) AS a FROM se WHERE r <= 4) SELECT company_id, section, count(*) AS periods, round(max(a) - min(a), 6) AS range, 0.6::DOUBLE AS score FROM ow GROUP BY ALL HAVING count(*) >= 3 AND sum(fell) = 0 AND max(a) - min(a) < 0.02",
    "going_concern": f"WITH {_SE}, {_PAIRS}, {_GC} SELECT * FROM gx",
    "sentiment_reversal": f"WITH {_SE}, {_RV} SELECT * FROM rv",
    "explosion": f"WITH {F_SQL}, {_EV}, {_EX} SELECT * FROM ex",
    "silent_deletion": f"WITH {F_SQL}, {_EV}, sd AS (SELECT company_id, filing_date, count(*) AS k FROM ev WHERE kind = 'removed' GROUP BY ALL) SELECT company_id, sum(k)::BIGINT AS total, max_by(k, filing_date) AS latest, round(least(max_by(k, filing_date) / 10.0::DOUBLE, 1.0), 3) AS score FROM sd GROUP BY company_id HAVING sum(k) >= 2 AND max_by(k, filing_date) >= 2",
    "peer_divergence": f"WITH {_SE}, {_SEC}, {_LT}, l3 AS (SELECT l2.*, sector FROM l2 JOIN sx USING (company_id) WHERE sector IS NOT NULL), pd AS (SELECT *, CASE WHEN peer_std >= 0.001 THEN (drift - peer_mean) / peer_std END AS z FROM {_loo('l3', 'sector', 'drift')} q WHERE peers >= 3) SELECT company_id, sector, peers, round(drift, 6) AS drift, round(z, 4) AS z, round(least(z / 4, 1.0), 4) AS score FROM pd WHERE z >= 1.5::DOUBLE",
    "peer_divergence_mild": f"WITH {_SE}, {_SEC}, {_LT}, l3 AS (SELECT l2.*, sector FROM l2 JOIN sx USING (company_id) WHERE sector IS NOT NULL), pd AS (SELECT *, CASE WHEN peer_std >= 0.001 THEN (drift - peer_mean) / peer_std END AS z FROM {_loo('l3', 'sector', 'drift')} q WHERE peers >= 3) SELECT company_id, sector, peers, round(drift, 6) AS drift, round(z, 4) AS z, round(least(z / 4, 1.0), 4) AS score FROM pd WHERE z >= 0.5::DOUBLE",
    "market_divergence_mild": f"WITH {_SE}, {_LT}, {_MDS.replace('{limit}', '1.0')} SELECT * FROM mv",
    "sector_trends_wide": f"WITH {D_SQL}, {_SQW} SELECT * FROM ss",
    "market_divergence": f"WITH {_SE}, {_LT}, {_MD} SELECT * FROM mv",
    "leave_one_out": f"WITH {D_SQL}, q AS (SELECT id, section, form, cosine FROM dr WHERE cosine IS NOT NULL), m AS (SELECT section, form, avg(cosine) AS m, count(*) AS k FROM q GROUP BY ALL), c AS (SELECT id, section, form, cosine - m AS d, m, k FROM q JOIN m USING (section, form)), s AS (SELECT section, form, sum(d) AS s, sum(d * d) AS ss FROM c GROUP BY ALL) SELECT id, k - 1 AS peers, round(m + (s - d) / nullif(k - 1, 0), 9) AS peer_mean, round(sqrt(greatest((ss - d * d) / nullif(k - 1, 0) - ((s - d) / nullif(k - 1, 0)) ** 2, 0.0)), 9) AS peer_std FROM c JOIN s USING (section, form)",
    "sector_trends": f"WITH {D_SQL}, {_SQ} SELECT * FROM ss",
    "phrase_propagation": f"WITH {S_SQL}, {_PP} SELECT * FROM pp",
    "risk_score_components": f"WITH {_ALL} SELECT * FROM ri",
    "risk_levels": f"WITH {_ALL} SELECT risk_level, count(*) AS n, round(avg(risk_score), 4) AS mean_score FROM ri GROUP BY ALL",
    "pattern_scores": f"WITH {_SE}, {_EV}, {_PT} SELECT company_id, pattern, round(score, 4) AS score FROM pt",
    "findings": f"WITH {_ALL}, {_PT}, {_FI} SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank FROM fi",
    "predictions": f"WITH {_ALL}, {_PT}, {_FI}, {_PR}",
    "comparables": f"WITH {_SE}, {_SEC}, {_LT}, cm AS (SELECT a.company_id, b.company_id AS other_id, round(greatest(1 - abs(a.drift - b.drift) / greatest(a.drift, b.drift, 0.01), 0.0), 3) AS similarity FROM l2 a JOIN sx p ON p.company_id = a.company_id JOIN sx q ON q.sector = p.sector JOIN l2 b ON b.company_id = q.company_id AND b.company_id <> a.company_id) SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY similarity DESC, other_id)::INT AS rank, other_id, similarity FROM cm WHERE similarity > 0.5 QUALIFY rank <= 5",
    "overview": f"WITH {_SE}, {_CA}, {_KD}, {_KI}, {_TR} SELECT ca.company_id, ca.section, filing_id, CASE WHEN cosine <> 0 THEN round(cosine, 4) END AS cosine, round(z, 4) AS z, {_level('z', 'NULL', 'cosine')} AS level, phase, drift_acceleration OR drift_spike OR elevated_baseline OR sentiment_deterioration OR uncertainty_increasing AS has_trend FROM ca LEFT JOIN ki USING (company_id, section) LEFT JOIN tr USING (company_id, section) WHERE r = 1",
    "headlines": f"WITH {_ALL}, {_PT}, {_FI}, {_FT}, {_HL} SELECT * FROM hl",
    "actions": f"WITH {_ALL}, {_PT}, {_FI}, {_FT}, {_AC} SELECT company_id, no::INT AS no, action FROM ac",
    "intelligence": f"WITH {_ALL}, {_PT}, {_FI}, {_FT}, {_HL}, {_AC}, {_PR0}, {_CM} SELECT ri.company_id, risk_score, risk_level, headline, (SELECT count(*) FROM fi WHERE fi.company_id = ri.company_id) AS n_findings, (SELECT count(*) FROM px WHERE px.company_id = ri.company_id) AS n_predictions, (SELECT count(*) FROM ac WHERE ac.company_id = ri.company_id) AS n_actions, (SELECT count(*) FROM cx WHERE cx.company_id = ri.company_id) AS n_comparables FROM ri JOIN hl USING (company_id)",
    "market_report": f"WITH {_SE}, cs AS (SELECT f.company_id, f.filing_date, s.section_text FROM (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY filing_id, lower(section_type) ORDER BY id DESC) = 1) s JOIN f USING (filing_id)), {_SQ}, {_LT}, {_MD}, {_PP} SELECT 'market_drift' AS metric, round(coalesce(avg(cosine), 0.0), 6) AS value FROM dr UNION ALL SELECT 'sector_trend', count(*)::DOUBLE FROM ss UNION ALL SELECT 'divergence', count(*)::DOUBLE FROM mv UNION ALL SELECT 'propagation', count(*)::DOUBLE FROM pp",
    "percentile_thresholds": f"WITH {D_SQL} SELECT section, " + ", ".join(f"round(quantile_cont(cosine, {p}), 9) AS p{int(p * 100)}" for p in (0.2, 0.5, 0.75, 0.9)) + " FROM dr WHERE cosine IS NOT NULL GROUP BY section",
    "backtest_metrics": f"""WITH {D_SQL}, bt AS (SELECT filing_id, section, 0.7::DOUBLE * coalesce(cosine, 0) + 0.3::DOUBLE * coalesce(jaccard, 0) AS drift, TRY_CAST(CASE WHEN json_valid(sd) THEN sd ->> '$.negative' END AS DOUBLE) AS neg FROM (SELECT *, sentiment_delta AS sd FROM dr)),
li AS (SELECT section, quantile_cont(drift, 0.75) AS lim FROM bt GROUP BY ALL UNION ALL SELECT 'all', quantile_cont(drift, 0.75) FROM bt), nx AS (SELECT filing_id, lead(filing_id) OVER (PARTITION BY company_id ORDER BY filing_date, filing_id) AS next_id FROM f), bo AS (SELECT filing_id AS next_id, bool_or(coalesce(neg > 0.05, false)) AS bad FROM bt GROUP BY ALL),
sc AS (SELECT section, drift, coalesce(bad, false) AS bad FROM bt JOIN nx USING (filing_id) LEFT JOIN bo USING (next_id) WHERE next_id IS NOT NULL), bb AS (SELECT * FROM sc UNION ALL SELECT 'all', drift, bad FROM sc),
g AS (SELECT section, count(*) AS n, count_if(drift >= lim) AS high, count_if(drift >= lim AND bad) AS hits, count_if(bad) AS bad, count_if(drift < lim AND NOT bad) AS clean, any_value(lim) AS lim FROM bb JOIN li USING (section) GROUP BY ALL),
h AS (SELECT *, coalesce(hits / nullif(high, 0)::DOUBLE, 0.0) AS p, coalesce(hits / nullif(bad, 0)::DOUBLE, 0.0) AS r FROM g)
SELECT section, n, high::BIGINT AS high, hits::BIGINT AS hits, bad::BIGINT AS bad, clean::BIGINT AS clean, round(lim, 9) AS "limit", round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1 FROM h""",
    "label_histogram": "SELECT least(floor(similarity_score * 10), 9)::INT AS bucket, count(*) AS n FROM sentence_changes WHERE similarity_score IS NOT NULL GROUP BY 1",
    "linear_extrapolation": f"WITH {_SE}, g AS (SELECT company_id, section, count(*) AS k, regr_slope(cosine, i) AS slope, avg(cosine) AS my, avg(i) AS mi FROM se WHERE n >= 3 GROUP BY ALL) SELECT company_id, section, round(slope, 9) AS slope, round(my + slope * (k + 1 - mi), 9) AS next FROM g",
}
