"""Time series of drift: anomalies, trends, kinematics, patterns, peers.

A series is one (company_id, section) in order of (filing_date, filing_id).
``base`` numbers it from both ends, so rules about "the last four" are plain
conditional aggregates and no series is ever collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relational import json_number

KEY = ["company_id", "section"]


def _w() -> Window:
    return Window.partitionBy(*KEY).orderBy("filing_date", "filing_id")


def _back() -> Window:
    return Window.partitionBy(*KEY).orderBy(F.desc("filing_date"), F.desc("filing_id"))


def base(drift: DataFrame) -> DataFrame:
    """(company_id, section, filing_id, filing_date, cosine, neg, pos, unc, i, r, n); scores without a value are left out."""
    rows = drift.where("cosine is not null").select(*KEY, "filing_id", "filing_date", "cosine", *[json_number(F.col("sentiment_delta"), k).alias(a) for k, a in (("negative", "neg"), ("positive", "pos"), ("uncertainty", "unc"))])
    return rows.withColumn("i", F.row_number().over(_w())).withColumn("r", F.row_number().over(_back())).withColumn("n", F.col("i") + F.col("r") - 1)


def zscore(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std >= 0.001, (value - mean) / std)


def level(company_z: Column, sector_z: Column, value: Column, sector_limit: float = 2.5) -> Column:
    """normal, elevated, high or extreme; a sector's z-score lifts one step; without any z-score the value decides."""
    own = F.when(company_z > 3.0, 3).when(company_z > 2.0, 2).when(company_z > 1.4, 1).otherwise(0)
    lifted = F.when((sector_z > sector_limit) & (own == 0), 1).when((sector_z > sector_limit) & (own == 1), 2).otherwise(own)
    plain = F.when(value > 0.3, 2).when(value > 0.2, 1).otherwise(0)
    code = F.when(company_z.isNull() & sector_z.isNull(), plain).otherwise(lifted)
    return F.element_at(F.array(*[F.lit(x) for x in ("normal", "elevated", "high", "extreme")]), (code + 1).cast("int"))


def company_anomaly(s: DataFrame) -> DataFrame:
    """Each value against the values before it; three of them at least."""
    before = _w().rowsBetween(Window.unboundedPreceding, -1)
    mean, std, k = F.avg("cosine").over(before), F.stddev_pop("cosine").over(before), F.count("*").over(before)
    rows = s.withColumn("mean", F.when(k >= 3, mean)).withColumn("std", F.when(k >= 3, std)).withColumn("z", zscore(F.col("cosine"), F.col("mean"), F.col("std")))
    return rows.withColumn("level", level(F.col("z"), F.lit(None).cast("double"), F.col("cosine")))


def leave_one_out(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean and population deviation of each row's group without the row itself, by two passes of partial sums around the group's mean.

    A row without peers has no mean and a deviation of 0.
    """
    m = rows.groupBy(*group).agg(F.avg(value).alias("m_"))
    centred = rows.join(m, group).withColumn("d_", F.col(value) - F.col("m_"))
    sums = centred.groupBy(*group).agg(F.count("*").alias("k_"), F.sum("d_").alias("s_"), F.sum(F.col("d_") * F.col("d_")).alias("q_"))
    j = centred.join(sums, group).withColumn("peers", F.col("k_") - 1)
    mean = F.try_divide(F.col("s_") - F.col("d_"), F.col("peers"))
    var = F.try_divide(F.col("q_") - F.col("d_") * F.col("d_"), F.col("peers")) - mean * mean
    return j.withColumn("peer_mean", F.col("m_") + mean).withColumn("peer_std", F.sqrt(F.greatest(var, F.lit(0.0)))).drop("m_", "d_", "k_", "s_", "q_")


def _last(k: int, c: str) -> Column:
    return F.max(F.when(F.col("r") == k, F.col(c)))


def _first(k: int, c: str) -> Column:
    return F.max(F.when(F.col("i") == k, F.col(c)))


def trends(s: DataFrame) -> DataFrame:
    """Five trend signals at the end of each series of four values or more."""
    c = {f"c{k}": _last(k, "cosine") for k in (1, 2, 3, 4)} | {f"e{k}": _first(k, "cosine") for k in (1, 2, 3, 4)}
    c |= {f"{a}{k}": F.max(F.when(F.col("r") == k, F.coalesce(a, F.lit(0.0)))) for a in ("neg", "unc") for k in (1, 2, 3, 4)}
    g = s.groupBy(*KEY).agg(F.max("n").alias("periods"), *[v.alias(k) for k, v in c.items()]).where("periods >= 4")
    x = F.col
    before = (x("c2") + x("c3") + x("c4")) / 3
    early, late = (x("e1") + x("e2") + x("e3") + x("e4")) / 4, (x("c1") + x("c2") + x("c3") + x("c4")) / 4
    rising = lambda a: (x(f"{a}4") <= x(f"{a}3")) & (x(f"{a}3") <= x(f"{a}2")) & (x(f"{a}2") <= x(f"{a}1")) & (x(f"{a}1") > x(f"{a}4"))
    return g.select(
        *KEY, "periods", ((x("c4") < x("c3")) & (x("c3") < x("c2")) & (x("c2") < x("c1"))).alias("drift_acceleration"), ((before > 0) & (x("c1") > before * 2)).alias("drift_spike"),
        ((x("periods") >= 8) & (early > 0) & (late > early * 1.5)).alias("elevated_baseline"), rising("neg").alias("sentiment_deterioration"), rising("unc").alias("uncertainty_increasing"),
    )


def derivatives(s: DataFrame) -> DataFrame:
    """Velocity, acceleration and jerk of each value, in years; null where the series is too short. Equal dates count as 1e-6 years apart."""
    gap = F.datediff("filing_date", F.lag("filing_date").over(_w())) / 365.25
    rows = s.withColumn("dt", F.when(gap == 0, 1e-6).otherwise(gap)).withColumn("velocity", (F.col("cosine") - F.lag("cosine").over(_w())) / F.col("dt"))
    rows = rows.withColumn("da", (F.lag("dt").over(_w()) + F.col("dt")) / 2).withColumn("acceleration", (F.col("velocity") - F.lag("velocity").over(_w())) / F.col("da"))
    return rows.withColumn("jerk", (F.col("acceleration") - F.lag("acceleration").over(_w())) / ((F.lag("da").over(_w()) + F.col("da")) / 2))


def momentum(d: DataFrame, halflife: int = 3) -> DataFrame:
    """Exponential moving average of the velocities of each series.

    The sum of alpha * (1 - alpha)**age * v is a plain aggregate; the first
    velocity seeds the average and so has no alpha.
    """
    keep = math.exp(-math.log(2) / max(halflife, 1))
    age = F.col("r") - 1
    share = F.when(F.col("i") == 2, F.lit(1.0)).otherwise(1 - keep)
    return d.where("velocity is not null").groupBy(*KEY).agg(F.sum(share * F.pow(F.lit(keep), age) * F.col("velocity")).alias("momentum"))


def phase(v: Column, a: Column, j: Column, sigma: Column) -> Column:
    return (
        F.when((F.abs(j) > 0.015) & (F.abs(a) > 0.01), "regime_change").when((F.abs(j) > 0.005) | (sigma > 0.05), "volatile").when(a > 0.01, "accelerating").when(a < -0.01, "decelerating")
        .when(F.abs(v) > 0.01, "drifting").otherwise("stable")
    )


def kinematics(s: DataFrame) -> DataFrame:
    """Latest derivatives, velocity statistics, momentum and phase of each series of two values or more."""
    d = derivatives(s)
    g = d.groupBy(*KEY).agg(
        F.max("n").alias("points"), *[F.coalesce(_last(1, c), F.lit(0.0)).alias(c) for c in ("velocity", "acceleration", "jerk")],
        F.avg("velocity").alias("mean_velocity"), F.stddev_pop("velocity").alias("std_velocity"), F.max(F.abs("velocity")).alias("max_velocity"),
    )
    g = g.where("points >= 2").join(momentum(d), KEY)
    return g.withColumn("phase", phase(F.col("velocity"), F.col("acceleration"), F.col("jerk"), F.col("std_velocity")))


def streaks(s: DataFrame) -> DataFrame:
    """Values in the strictly rising run at the end of each series, if three or more: (key, streak, score)."""
    falls = s.withColumn("falls", F.when(F.col("cosine") > F.lag("cosine").over(_w()), None).otherwise(F.col("r")))
    g = falls.groupBy(*KEY).agg(F.min("falls").alias("streak"))  # the last value that does not rise begins the run
    return g.where("streak >= 3").select(*KEY, "streak", F.round(F.least(F.col("streak") / 6, F.lit(1.0)), 3).alias("score"))


def obfuscation_wave(s: DataFrame) -> DataFrame:
    """Series whose last four (three at least) values never fall while negativity hardly moves."""
    last = s.where("r <= 4").withColumn("fell", F.when(F.col("cosine") < F.lag("cosine").over(_w()), 1).otherwise(0)).withColumn("a", F.abs(F.coalesce("neg", F.lit(0.0))))
    g = last.groupBy(*KEY).agg(F.count("*").alias("k"), F.sum("fell").alias("falls"), (F.max("a") - F.min("a")).alias("range"))
    return g.where("k >= 3 and falls = 0 and range < 0.02").select(*KEY, F.col("k").alias("periods"), F.round("range", 6).alias("range"), F.lit(0.6).alias("score"))


def reversal(s: DataFrame) -> DataFrame:
    """Positive sentiment above 0.01 that more than halved in the last two scores that have one."""
    known = s.where("pos is not null").withColumn("r", F.row_number().over(_back()))
    g = known.groupBy(*KEY).agg(_last(2, "pos").alias("before"), _last(1, "pos").alias("now")).where("before > 0.01 and now < 0.5 * before")
    return g.select(*KEY, "before", "now", F.round(F.least((1 - F.col("now") / F.col("before")), F.lit(1.0)), 4).alias("score"))


# Words of doubt about a company's future.
CONCERN = ["going concern", "substantial doubt", "ability to continue"]


def going_concern(s: DataFrame, moves: DataFrame, words: list[str] = CONCERN) -> DataFrame:
    """(company_id, phrases, rising, score): companies in whose texts a phrase of concern appeared; 0.7 if negativity rose in the last two scores that have one, else 0.4.

    ``moves`` has (company_id, phrase, status).
    """
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("phrase"), F.lit(w))
    new = moves.where((F.col("status") == "appeared") & hit).groupBy("company_id").agg(F.count_distinct("phrase").alias("phrases"))
    back = Window.partitionBy("company_id").orderBy(F.desc("filing_date"), F.desc("filing_id"), F.desc("section"))
    last = s.where("neg is not null").select("company_id", "neg", F.row_number().over(back).alias("r")).where("r <= 2").groupBy("company_id").agg(_last(1, "neg").alias("now"), _last(2, "neg").alias("before"))
    j = new.join(last, "company_id", "left").withColumn("rising", F.coalesce(F.col("now") > F.col("before"), F.lit(False)))
    return j.select("company_id", "phrases", "rising", F.when(F.col("rising"), 0.7).otherwise(0.4).alias("score"))


def explosion(events: DataFrame) -> DataFrame:
    """Companies whose latest day has twice the mean count of the days before: (company_id, latest, baseline, score).

    ``events`` has a row for each new phrase or sentence (company_id, filing_date).
    """
    days = events.groupBy("company_id", "filing_date").agg(F.count("*").alias("k"))
    days = days.withColumn("r", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("filing_date"))))
    g = days.groupBy("company_id").agg(_last(1, "k").alias("latest"), F.avg(F.when(F.col("r") > 1, F.col("k"))).alias("baseline"))
    return g.where("baseline > 0 and latest >= 2 * baseline").select("company_id", "latest", F.round("baseline", 6).alias("baseline"), F.round(F.least(F.col("latest") / (F.col("baseline") * 4), F.lit(1.0)), 6).alias("score"))


def silent_deletion(events: DataFrame) -> DataFrame:
    """Companies with two removals or more in all and on their latest day of removals."""
    days = events.groupBy("company_id", "filing_date").agg(F.count("*").alias("k"))
    g = days.groupBy("company_id").agg(F.sum("k").alias("total"), F.max_by("k", "filing_date").alias("latest"))
    return g.where("total >= 2 and latest >= 2").select("company_id", "total", "latest", F.round(F.least(F.col("latest") / 10, F.lit(1.0)), 3).alias("score"))


def peer_divergence(s: DataFrame, sectors: DataFrame, least: float = 1.5, peers: int = 3) -> DataFrame:
    """Companies whose latest mean drift lies above that of the others of their sector."""
    latest = s.join(s.groupBy("company_id").agg(F.max("filing_date").alias("filing_date")), ["company_id", "filing_date"]).groupBy("company_id").agg(F.avg("cosine").alias("drift"))
    j = leave_one_out(latest.join(sectors.where("sector is not null"), "company_id"), ["sector"], "drift").where(F.col("peers") >= peers)
    j = j.withColumn("z", zscore(F.col("drift"), F.col("peer_mean"), F.col("peer_std"))).where(F.col("z") >= least)
    return j.select("company_id", "sector", "peers", F.round("drift", 6).alias("drift"), F.round("z", 4).alias("z"), F.round(F.least(F.col("z") / 4, F.lit(1.0)), 4).alias("score"))


def market_divergence(s: DataFrame, limit: float = 2.0) -> DataFrame:
    """Companies whose latest mean drift lies far from that of all others."""
    latest = s.join(s.groupBy("company_id").agg(F.max("filing_date").alias("filing_date")), ["company_id", "filing_date"]).groupBy("company_id").agg(F.avg("cosine").alias("drift"))
    j = leave_one_out(latest.withColumn("all", F.lit(1)), ["all"], "drift").where("peers >= 2")
    j = j.withColumn("z", zscore(F.col("drift"), F.col("peer_mean"), F.col("peer_std"))).where(F.abs("z") > limit)
    return j.select("company_id", F.round("drift", 6).alias("drift"), F.round("z", 4).alias("z"), F.when(F.col("z") > 0, "UP").otherwise("DOWN").alias("direction"), F.round(F.least(F.abs("z") / 5, F.lit(1.0)), 3).alias("significance"))


def sector_trends(drift: DataFrame, companies: DataFrame, least: int = 3) -> DataFrame:
    """Quarters in which three or more companies of a sector drift more than in the sector's previous quarter with scores."""
    q = drift.where("cosine is not null").join(companies.select(F.col("id").alias("company_id"), F.coalesce(F.nullif(F.col("sic_code"), F.lit("")), F.lit("unknown")).alias("sector")), "company_id")
    q = q.withColumn("quarter", F.concat(F.year("filing_date"), F.lit("-Q"), F.quarter("filing_date"))).groupBy("sector", "quarter", "company_id").agg(F.avg("cosine").alias("m"))
    order = q.select("sector", "quarter").distinct().withColumn("no", F.row_number().over(Window.partitionBy("sector").orderBy("quarter")))
    n = q.join(order, ["sector", "quarter"])
    prev = n.select("sector", "company_id", (F.col("no") + 1).alias("no"), F.col("m").alias("before"))
    up = n.join(prev, ["sector", "company_id", "no"]).where("m > before")
    g = up.groupBy("sector", "quarter").agg(F.count("*").alias("companies"), F.avg(F.col("m") - F.col("before")).alias("rise")).where(F.col("companies") >= least)
    # scores have six digits: a half must not depend on the order of a sum
    return g.select("sector", "quarter", "companies", F.round(F.col("rise") + 1e-11, 6).alias("rise"), F.round(F.least(F.lit(1.0), F.col("rise") * 10), 3).alias("significance"))


def propagation(seen: DataFrame, least: int = 2) -> DataFrame:
    """(phrase, first_company, first_date, followers, mean_lag, significance) of phrases that spread one to four quarters later.

    ``seen`` has (phrase, company_id, seen_date) for each appearance; the first
    one of each company counts, of one day the smaller id comes first.
    """
    from tidemark.operators.relational import quarters_between

    first = seen.groupBy("phrase", "company_id").agg(F.min("seen_date").alias("seen_date"))
    mover = first.groupBy("phrase").agg(F.min(F.struct("seen_date", "company_id")).alias("m"), F.count("*").alias("k")).where(F.col("k") >= least)
    j = first.join(mover, "phrase").where("company_id <> m.company_id").withColumn("lag", quarters_between(F.col("m.seen_date"), F.col("seen_date"))).where("lag between 1 and 4")
    g = j.groupBy("phrase").agg(F.first("m").alias("m"), F.count("*").alias("followers"), F.avg("lag").alias("mean_lag"))
    return g.select("phrase", F.col("m.company_id").alias("first_company"), F.col("m.seen_date").alias("first_date"), "followers", F.round("mean_lag", 4).alias("mean_lag"), F.round(F.least(F.lit(1.0), 0.2 * F.col("followers") + 0.3 / F.col("mean_lag")), 3).alias("significance"))
