"""Composite risk: components, findings, predictions, comparables, backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clamp
from tidemark.operators import series as S
from tidemark.operators.medians import medians

# Weights of the components and limits of the levels.
WEIGHTS = {"anomaly": 0.25, "acceleration": 0.20, "sentiment": 0.15, "phrases": 0.15, "obfuscation_proxy": 0.10, "entropy_proxy": 0.10, "alerts": 0.05}
LEVELS = ((0.75, "critical"), (0.60, "high"), (0.45, "elevated"), (0.30, "moderate"), (0.15, "low"))


def risk_level(score: Column) -> Column:
    out = F.lit("minimal")
    for limit, name in reversed(LEVELS):
        out = F.when(score >= limit, name).otherwise(out)
    return out


def risk_scores(s: DataFrame, phrases: DataFrame, alerts: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """One row for each company: seven components in [0, 1], their weighted score and its level.

    ``s`` is a series base, ``phrases`` has (company_id, n_new, n_critical) of the
    latest filing, ``alerts`` (company_id, n_alerts). Kinematics are those of risk_factors,
    else of the first section by name.
    """
    everything = Window.partitionBy("company_id").orderBy("filing_date", "filing_id", "section")
    back = Window.partitionBy("company_id").orderBy(F.desc("filing_date"), F.desc("filing_id"), F.desc("section"))
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    rows = s.withColumn("k", F.count("*").over(before)).withColumn("mean", F.avg("cosine").over(before)).withColumn("std", F.stddev_pop("cosine").over(before)).withColumn("r", F.row_number().over(back))
    known = s.where("neg is not null").withColumn("r", F.row_number().over(back)).where("r <= 4")
    senti = known.groupBy("company_id").agg(F.count("*").alias("known"), F.max_by("neg", F.struct("r")).alias("oldest"), F.min_by("neg", F.struct("r")).alias("newest"))
    last = rows.where("r = 1").select("company_id", "cosine", "neg", F.when(F.col("k") >= 3, S.zscore(F.col("cosine"), F.col("mean"), F.col("std"))).alias("z"))
    kin = S.kinematics(s).withColumn("no", F.row_number().over(Window.partitionBy("company_id").orderBy(F.when(F.col("section") == "risk_factors", 0).otherwise(1), "section"))).where("no = 1").select("company_id", "acceleration", "phase")
    j = last.join(kin, "company_id", "left").join(senti, "company_id", "left").join(phrases, "company_id", "left").join(alerts, "company_id", "left")
    c, zero, one = F.col, F.lit(0.0), F.lit(1.0)
    plain = S.level(c("z"), F.lit(None).cast("double"), c("cosine"))
    parts = {
        "anomaly": F.when(c("z") > 0, F.least(c("z") / 4, one)).otherwise(F.when(plain == "extreme", 1.0).when(plain == "high", 0.7).when(plain == "elevated", 0.4).otherwise(0.0)),
        "acceleration": F.greatest(F.when(c("acceleration") > 0, F.least(c("acceleration") / 0.1, one)).otherwise(zero), F.when(c("phase") == "regime_change", 0.9).when(c("phase") == "accelerating", 0.5).otherwise(0.0)),
        "sentiment": F.when((c("known") >= 2) & (c("newest") > c("oldest")), F.least((c("newest") - c("oldest")) / 0.1, one)).otherwise(zero),
        "phrases": F.when(c("n_critical") > 0, F.least(c("n_critical") / 3, one)).when(c("n_new") > 10, 0.4).when(c("n_new") > 5, 0.2).otherwise(0.0),
        "obfuscation_proxy": F.when((c("cosine") > 0.15) & (F.coalesce("neg", zero) < 0.02), F.least(c("cosine") / 0.3, one) * 0.6).otherwise(zero),
        "entropy_proxy": F.when(c("cosine") > 0.2, F.least((c("cosine") - 0.1) / 0.3, one)).otherwise(zero),
        "alerts": F.least(F.least(F.coalesce("n_alerts", F.lit(0)), F.lit(10)) / 5, one),
    }
    scored = j.select("company_id", "phase", *[F.round(v, 6).alias(k) for k, v in parts.items()])
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return scored.withColumn("risk_score", F.round(clamp(total), 4)).withColumn("risk_level", risk_level(F.col("risk_score")))


def findings(scores: DataFrame, patterns: DataFrame) -> DataFrame:
    """(company_id, category, severity, severity_rank): what stands out, from components and pattern scores (company_id, pattern, score)."""
    rank = F.create_map(*[F.lit(x) for p in (("critical", 0), ("high", 1), ("medium", 2), ("low", 3)) for x in p])
    phase = F.when(F.col("phase") == "regime_change", "critical").when(F.col("phase") == "accelerating", "high").when(F.col("phase") == "volatile", "medium")
    one = scores.where("anomaly >= 0.4").select("company_id", F.lit("anomaly").alias("category"), F.when(F.col("anomaly") >= 0.75, "critical").when(F.col("anomaly") >= 0.5, "high").otherwise("medium").alias("severity"))
    two = scores.select("company_id", F.lit("kinematics"), phase.alias("severity")).where("severity is not null")
    three = scores.where("sentiment > 0.5").select("company_id", F.lit("sentiment"), F.lit("high"))
    four = scores.where("phrases > 0").select("company_id", F.lit("phrases"), F.when(F.col("phrases").isin(0.2, 0.4), "medium").otherwise("critical"))
    five = patterns.select("company_id", F.concat(F.lit("pattern:"), F.col("pattern")), F.when(F.col("score") > 0.6, "high").otherwise("medium"))
    return one.unionAll(two).unionAll(three).unionAll(four).unionAll(five).withColumn("severity_rank", F.coalesce(rank[F.col("severity")], F.lit(99)))


def _ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("no", F.row_number().over(Window.partitionBy("company_id").orderBy("severity_rank", "category")))


def headlines(scores: DataFrame, found: DataFrame, labels: DataFrame) -> DataFrame:
    """(company_id, headline, tone) from fixed templates; ``labels`` has (company_id, label)."""
    top = _ranked(found).where("no = 1").select("company_id", "category")
    tone = F.when(F.col("sentiment") > 0.15, "sharply more negative").when(F.col("sentiment") > 0.08, "more negative").otherwise("little changed")
    line = F.concat("label", F.lit(": "), F.initcap("risk_level"), F.lit(" risk -- "), F.coalesce("category", F.lit("no significant findings")))
    return scores.join(labels, "company_id").join(top, "company_id", "left").select("company_id", line.alias("headline"), tone.alias("tone"))


def actions(scores: DataFrame, found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(company_id, no, action): what the level, the most severe findings and the two strongest patterns call for."""
    s = scores.select("company_id", "risk_level")
    critical = found.where("severity = 'critical'").withColumn("no", F.row_number().over(Window.partitionBy("company_id").orderBy("category")))
    line = lambda rows, pos, text: rows.select("company_id", pos.cast("int").alias("pos"), text.alias("action"))
    level = lambda *names: s.where(F.col("risk_level").isin(*names))
    parts = [
        line(level("critical").join(critical.where("no <= 3"), "company_id"), F.col("no"), F.concat(F.lit("Immediate review required -- "), "category")),
        line(level("critical").join(critical, "company_id", "left_anti"), F.lit(1), F.lit("Immediate review required -- critical risk score")),
        line(level("high"), F.lit(0), F.lit("Monitor closely -- elevated risk across multiple signals")),
        line(level("high").join(_ranked(found).where("no <= 2 and severity in ('critical', 'high')"), "company_id"), F.col("no"), F.concat(F.lit("Investigate: "), "category")),
        line(level("elevated", "moderate"), F.lit(1), F.lit("Watch for escalation in the next filing period")),
        line(level("low", "minimal"), F.lit(1), F.lit("No action needed -- filing within historical norms")),
    ]
    best = patterns.withColumn("no", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("score"), "pattern"))).where("no <= 2 and (pattern = 'lazy_prices' and score > 0.5 or pattern = 'silent_deletion')")
    said = F.when(F.col("pattern") == "lazy_prices", "Review for Lazy Prices signal -- consider position adjustment").otherwise("Review removed risk phrases for potential concealment")
    parts.append(line(best.join(s, "company_id", "left_semi"), F.col("no") + 100, said))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("company_id", F.row_number().over(Window.partitionBy("company_id").orderBy("pos")).alias("no"), "action")


def predictions(scores: DataFrame, patterns: DataFrame, found: DataFrame) -> DataFrame:
    """(company_id, prediction, risk, confidence) from patterns and the overall score."""
    spec = F.when(F.col("pattern") == "lazy_prices", 0.7).when(F.col("pattern") == "going_concern", 0.8).when(F.col("pattern") == "sentiment_reversal", 0.6).when(F.col("pattern") == "explosion", 0.5)
    risk = F.when(F.col("pattern") == "going_concern", "high").when((F.col("pattern") == "lazy_prices") & (F.col("score") >= 0.7), "high").otherwise("moderate")
    one = patterns.where((F.col("pattern") != "lazy_prices") | (F.col("score") > 0.5)).where(spec.isNotNull()).select("company_id", F.col("pattern").alias("prediction"), risk.alias("risk"), F.round(F.col("score") * spec, 2).alias("confidence"))
    high = one.where("risk = 'high'").select("company_id").distinct()
    two = scores.where("risk_score >= 0.75").join(high, "company_id", "left_anti").select("company_id", F.lit("overall"), F.lit("high"), F.round(F.col("risk_score") * 0.6, 2))
    moved = found.where("category = 'kinematics'").select("company_id").distinct()
    three = scores.where("risk_score >= 0.45 and risk_score < 0.75").join(moved, "company_id", "left_semi").select("company_id", F.lit("acceleration"), F.lit("moderate"), F.round(F.col("risk_score") * 0.5, 2))
    return one.unionAll(two).unionAll(three)


def comparables(latest: DataFrame, sectors: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` companies of the same sector with the most similar latest drift, above 0.5: (company_id, rank, other_id, similarity).

    Equi-joined on sector and band of drift: similarity above 0.5 means that the
    larger of two drifts is less than twice the smaller or both lie near 0.
    """
    rows = latest.join(sectors.where("sector is not null"), "company_id")
    band = F.floor(F.log2(F.greatest(F.col("drift"), F.lit(0.005))))
    left = rows.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    right = rows.select("sector", band.alias("band"), F.col("company_id").alias("other_id"), F.col("drift").alias("other"))
    near = F.greatest(1 - F.abs(F.col("drift") - F.col("other")) / F.greatest("drift", "other", F.lit(0.01)), F.lit(0.0))
    j = left.join(right, ["sector", "band"]).where("company_id <> other_id").withColumn("similarity", F.round(near, 3)).where("similarity > 0.5")
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("similarity"), "other_id"))).where(F.col("rank") <= k).select("company_id", "rank", "other_id", "similarity")


def composite(cosine: Column, jaccard: Column) -> Column:
    return 0.7 * F.coalesce(cosine, F.lit(0.0)) + 0.3 * F.coalesce(jaccard, F.lit(0.0))


def backtest(drift: DataFrame, filings: DataFrame, share: float = 0.75) -> DataFrame:
    """Precision, recall and F1 of high drift as a warning of the next filing's negativity, overall and by section.

    High means at or above the exact 75th percentile, taken over all scores and
    over those of the section; a bad outcome is a next filing with a negative
    change above 0.05 in any section; scores of the last filing have none.
    """
    from tidemark.operators.relational import json_number

    d = drift.select("filing_id", "company_id", "section", composite(F.col("cosine"), F.col("jaccard")).alias("drift"), json_number(F.col("sentiment_delta"), "negative").alias("neg"))
    both = d.select("section", "drift").unionAll(d.select(F.lit("all").alias("section"), "drift"))
    limits = medians(both, ["section"], "drift", "limit", share).select("section", "limit")
    follows = filings.select("company_id", "filing_id", F.lead("filing_id").over(Window.partitionBy("company_id").orderBy("filing_date", "filing_id")).alias("next_id"))
    bad = d.groupBy("filing_id").agg(F.max(F.coalesce(F.col("neg") > 0.05, F.lit(False))).alias("bad")).withColumnRenamed("filing_id", "next_id")
    scored = d.join(follows.where("next_id is not null").select("filing_id", "next_id"), "filing_id").join(bad, "next_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    both = scored.unionAll(scored.withColumn("section", F.lit("all"))).join(F.broadcast(limits), "section")  # a row for each section
    high = F.col("drift") >= F.col("limit")
    g = both.groupBy("section").agg(F.count("*").alias("n"), F.count_if(high).alias("high"), F.count_if(high & F.col("bad")).alias("hits"), F.count_if("bad").alias("bad"), F.count_if(~high & ~F.col("bad")).alias("clean"), F.first("limit").alias("limit"))
    z = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("hits", "high"), z), F.coalesce(F.try_divide("hits", "bad"), z)
    return g.select("section", "n", "high", "hits", "bad", "clean", F.round("limit", 9).alias("limit"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), z), 6).alias("f1"))
