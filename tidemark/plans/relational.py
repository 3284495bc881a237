"""Relational queries: companies, filings, screener, watchlists, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.plans.views import D_SQL, F_SQL, clean_drift, clean_filings
from tidemark.sources.tables import table


def _companies(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "companies")


def company_search(spark: SparkSession, base: str) -> DataFrame:
    return R.search_companies(_companies(spark, base), "mar", 20).select("id", "ticker", "name")


def company_lookup(spark: SparkSession, base: str) -> DataFrame:
    return R.lookup(_companies(spark, base), "qvx1").select("id", R.padded_cik(F.col("cik")).alias("cik"), "ticker", "sic_code")


def company_dimension(spark: SparkSession, base: str) -> DataFrame:
    """Keys and names in normal form, a label for those without ticker or name."""
    c = _companies(spark, base)
    name = F.upper(F.trim(F.regexp_replace("name", r"\s+", " ")))
    return c.select("id", R.padded_cik(F.col("cik")).alias("cik"), F.coalesce(F.nullif(F.col("ticker"), F.lit("")), F.concat(F.lit("CID-"), "id")).alias("label"), name.alias("name"), F.substring("sic_code", 1, 2).alias("sector"))


def filing_urls(spark: SparkSession, base: str) -> DataFrame:
    f = clean_filings(spark, base)
    c = _companies(spark, base).select(F.col("id").alias("company_id"), R.padded_cik(F.col("cik")).alias("cik"))
    return f.join(c, "company_id").select("filing_id", R.document_url(F.col("cik"), F.col("accession"), F.lit("main.htm")).alias("url"))


def submissions_zip_rows(spark: SparkSession, base: str) -> DataFrame:
    """Parallel arrays of each company (a position is lost in one of them) and the annual rows of ten years zipped from them."""
    f = clean_filings(spark, base)
    rows = f.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("filing_id", "form", F.col("filing_date").cast("string").alias("d")))).alias("r"))
    arrays = rows.select("company_id", F.transform("r", lambda x: x["filing_id"]).alias("filing_id"), F.transform("r", lambda x: x["form"]).alias("form"), F.transform(F.slice("r", F.lit(1), F.size("r") - 1), lambda x: F.when(x["filing_id"] % 7 == 0, "").otherwise(x["d"])).alias("filing_date"))
    return R.zipped_rows(arrays, ["filing_id", "form", "filing_date"], ["10-K"], "2010-01-01", "2019-12-31")


def previous_filing_asof(spark: SparkSession, base: str) -> DataFrame:
    return R.previous_filing(clean_filings(spark, base)).select("filing_id", "prev_filing_id", "prev_date")


def latest_per_company(spark: SparkSession, base: str) -> DataFrame:
    return R.latest_rows(clean_filings(spark, base), ["company_id"], "filing_date").select("company_id", "filing_id", "filing_date")


def drift_timeline(spark: SparkSession, base: str) -> DataFrame:
    d = clean_drift(spark, base).where("section in ('risk_factors', 'mdna')")
    shown = lambda c: F.when(F.col(c) != 0, F.round(c, 4)).alias(c)
    return d.select("id", "company_id", "section", "filing_date", shown("cosine"), shown("jaccard"))


def screener(spark: SparkSession, base: str) -> DataFrame:
    return R.screener(clean_drift(spark, base), _companies(spark, base), "added_words")


def screener_page2(spark: SparkSession, base: str) -> DataFrame:
    return R.screener(clean_drift(spark, base), _companies(spark, base), "no_such_column", None, 20, 20)


def filing_page(spark: SparkSession, base: str) -> DataFrame:
    """The third page of ten of the filings not yet analysed, newest first."""
    f = clean_filings(spark, base).where("status <> 'analyzed'")
    return f.orderBy(F.desc("filing_date"), "filing_id").offset(20).limit(10).select("filing_id", "company_id", "form", "filing_date", "status")


def watched_semi(spark: SparkSession, base: str) -> DataFrame:
    """Companies on the watch list: those with a score whose drift is large."""
    d = clean_drift(spark, base).where("cosine > 0.6")
    return _companies(spark, base).withColumnRenamed("id", "company_id").join(d, "company_id", "left_semi").select("company_id", "ticker")


def unseen_anti(spark: SparkSession, base: str) -> DataFrame:
    """Filings without a score."""
    d = table(spark, base, "drift_scores", "filing_id")
    return clean_filings(spark, base).join(d, "filing_id", "left_anti").select("filing_id", "company_id", "status")


def enrich_left(spark: SparkSession, base: str) -> DataFrame:
    """Each filing with how many scores it has, null if none."""
    d = clean_drift(spark, base).groupBy("filing_id").agg(F.count("*").alias("n_scores"), F.round(F.max("cosine"), 6).alias("top"))
    return clean_filings(spark, base).select("filing_id").join(d, "filing_id", "left")


def forced_rewrite(spark: SparkSession, base: str) -> DataFrame:
    """Sentence changes that stay when the scores of the company that has most are written anew."""
    d = table(spark, base, "drift_scores", "id", "company_id").where("company_id = 1").select(F.col("id").alias("drift_score_id"))
    return R.rewritten(table(spark, base, "sentence_changes", "id", "drift_score_id"), d, "drift_score_id").select("id", "drift_score_id")


def _alerts(spark: SparkSession, base: str) -> DataFrame:
    """Alerts made from scores: severity by drift, every third one read."""
    d = clean_drift(spark, base).where("cosine > 0.25")
    severity = F.when(F.col("cosine") > 0.6, "critical").when(F.col("cosine") > 0.45, "high").when(F.col("cosine") > 0.35, "medium").otherwise("low")
    return d.select("id", "company_id", severity.alias("severity"), F.col("computed_at").alias("created_at"), (F.col("id") % 3 == 0).alias("read"))


def alert_digest(spark: SparkSession, base: str) -> DataFrame:
    return R.digest(_alerts(spark, base))


def alerts_marked_read(spark: SparkSession, base: str) -> DataFrame:
    a = _alerts(spark, base)
    return R.marked_read(a, a.where("severity = 'low'").select("id")).groupBy("severity").agg(F.count("*").alias("n"), F.sum(F.col("read").cast("bigint")).alias("n_read"))


def bridge_alerts(spark: SparkSession, base: str) -> DataFrame:
    """Alerts of watched companies through the bridge table (watchlist by sector)."""
    bridge = _companies(spark, base).where("sic_code is not null").select(F.substring("sic_code", 1, 2).alias("watchlist"), F.col("id").alias("company_id"))
    return _alerts(spark, base).join(bridge, "company_id").where("not read").groupBy("watchlist", "severity").agg(F.count("*").alias("n"), F.count_distinct("company_id").alias("companies"))


def json_delta(spark: SparkSession, base: str) -> DataFrame:
    """Sentiment changes from JSON that is not always well formed."""
    d = table(spark, base, "drift_scores", "id", "sentiment_delta")
    return d.select("id", *[R.json_number(F.col("sentiment_delta"), k).alias(k) for k in ("negative", "positive", "uncertainty")])


def hash_keys(spark: SparkSession, base: str) -> DataFrame:
    """Cache keys and expiry of entries kept for a day."""
    c = table(spark, base, "companies", "id", "cik", "created_at")
    return c.select("id", R.cache_key(F.lit("intelligence"), F.col("cik"), F.col("id").cast("string")).alias("key"), (F.col("created_at") + F.expr("INTERVAL 24 HOURS") < F.lit("2021-01-01").cast("timestamp_ntz")).alias("expired"))


def quarter_math(spark: SparkSession, base: str) -> DataFrame:
    p = R.previous_filing(clean_filings(spark, base)).where("prev_date is not null")
    return p.select("filing_id", R.quarter_label(F.col("filing_date")).alias("quarter"), (R.quarter_number(F.col("filing_date")) - R.quarter_number(F.col("prev_date"))).alias("quarters_apart"), R.quarters_between(F.col("prev_date"), F.col("filing_date")).alias("quarters_rounded"))


def retrain_trigger(spark: SparkSession, base: str) -> DataFrame:
    """Whether enough was analysed since the last training (100 filings, or 30 days as of a date)."""
    f = clean_filings(spark, base).where("status = 'analyzed'")
    g = f.agg(F.count("*").alias("n_analyzed"), F.datediff(F.lit("2026-06-01").cast("date"), F.max("filing_date")).alias("days"))
    return g.select("n_analyzed", "days", ((F.col("n_analyzed") >= 100) | (F.col("days") > 30)).alias("retrain"))


def ingest_new(spark: SparkSession, base: str) -> DataFrame:
    """Of the filings of one form at hand, those whose accession no analysed filing has."""
    f = clean_filings(spark, base)
    known = f.where("status = 'analyzed'").select("accession")
    return f.where("form = '10-K'").join(known, "accession", "left_anti").select("filing_id", "accession")


def next_filing(spark: SparkSession, base: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("company_id").orderBy("filing_date", "filing_id")
    return clean_filings(spark, base).select("filing_id", F.lead("filing_id").over(w).alias("next_filing_id"))


def dashboard(spark: SparkSession, base: str) -> DataFrame:
    """The start page's numbers: unread and critical alerts, distinct companies, by severity."""
    return _alerts(spark, base).groupBy("severity").agg(F.count_if(~F.col("read")).alias("unread"), F.count_distinct("company_id").alias("companies"))


def status_rollup(spark: SparkSession, base: str) -> DataFrame:
    f = clean_filings(spark, base)
    return f.rollup("form", "status").agg(F.count("*").alias("n"), F.min("filing_date").alias("first_date"))


QUERIES = {
    f.__name__: f
    for f in (company_search, company_lookup, company_dimension, filing_urls, submissions_zip_rows, previous_filing_asof, latest_per_company, drift_timeline, screener, screener_page2, filing_page, watched_semi, unseen_anti, enrich_left, forced_rewrite, alert_digest, alerts_marked_read, bridge_alerts, json_delta, hash_keys, quarter_math, retrain_trigger, ingest_new, next_filing, dashboard, status_rollup)
}

_CIK = "lpad(trim(cik), 10, '0')"
_AL = "al AS (SELECT id, company_id, CASE WHEN cosine > 0.6 THEN 'critical' WHEN cosine > 0.45 THEN 'high' WHEN cosine > 0.35 THEN 'medium' ELSE 'low' END AS severity, computed_at AS created_at, id % 3 = 0 AS read FROM dr WHERE cosine > 0.25)"
_SHOW = "CASE WHEN {c} <> 0 THEN round({c}, 4) END AS {c}"
_PREV = "pv AS (SELECT a.filing_id, a.filing_date, b.filing_id AS prev_filing_id, b.filing_date AS prev_date FROM f a LEFT JOIN f b ON a.company_id = b.company_id AND a.form = b.form AND b.filing_date < a.filing_date QUALIFY row_number() OVER (PARTITION BY a.filing_id ORDER BY b.filing_date DESC, b.filing_id DESC) = 1)"
_SCREEN = "lt AS (SELECT dr.* FROM dr JOIN (SELECT company_id, max(computed_at) AS m FROM dr GROUP BY ALL) x ON x.company_id = dr.company_id AND x.m = dr.computed_at)"
_COLS = f"lt.id, company_id, ticker, section, filing_date, {_SHOW.format(c='cosine')}, {_SHOW.format(c='jaccard')}, added_words, removed_words"

SQL = {
    "company_search": "SELECT id, ticker, name FROM companies WHERE contains(upper(ticker), 'MAR') OR contains(upper(name), 'MAR') ORDER BY id LIMIT 20",
    "company_lookup": f"SELECT id, {_CIK} AS cik, ticker, sic_code FROM companies WHERE upper(ticker) = 'QVX1'",
    "company_dimension": f"SELECT id, {_CIK} AS cik, coalesce(nullif(ticker, ''), 'CID-' || id) AS label, upper(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS name, substring(sic_code, 1, 2) AS sector FROM companies",
    "filing_urls": f"WITH {F_SQL} SELECT filing_id, 'https://filings.example/' || regexp_replace({_CIK}, '^0+', '') || '/' || accession || '/main.htm' AS url FROM f JOIN companies c ON c.id = f.company_id",
    "submissions_zip_rows": f"WITH {F_SQL}, r AS (SELECT company_id, filing_id, form, filing_date, row_number() OVER (PARTITION BY company_id ORDER BY filing_id) AS i, count(*) OVER (PARTITION BY company_id) AS n FROM f), z AS (SELECT company_id, filing_id, form, CASE WHEN i = n OR filing_id % 7 = 0 THEN NULL ELSE filing_date END AS filing_date FROM r) SELECT * FROM z WHERE form = '10-K' AND (filing_date IS NULL OR filing_date BETWEEN DATE '2010-01-01' AND DATE '2019-12-31')",
    "previous_filing_asof": f"WITH {F_SQL}, {_PREV} SELECT filing_id, prev_filing_id, prev_date FROM pv",
    "latest_per_company": f"WITH {F_SQL} SELECT company_id, filing_id, filing_date FROM f QUALIFY filing_date = max(filing_date) OVER (PARTITION BY company_id)",
    "drift_timeline": f"WITH {D_SQL} SELECT id, company_id, section, filing_date, {_SHOW.format(c='cosine')}, {_SHOW.format(c='jaccard')} FROM dr WHERE section IN ('risk_factors', 'mdna')",
    "screener": f"WITH {D_SQL}, {_SCREEN} SELECT {_COLS} FROM lt JOIN companies c ON c.id = lt.company_id ORDER BY lt.added_words DESC NULLS LAST, lt.id LIMIT 50",
    "screener_page2": f"WITH {D_SQL}, {_SCREEN} SELECT {_COLS} FROM lt JOIN companies c ON c.id = lt.company_id ORDER BY lt.cosine DESC NULLS LAST, lt.id LIMIT 20 OFFSET 20",
    "filing_page": f"WITH {F_SQL} SELECT filing_id, company_id, form, filing_date, status FROM f WHERE status <> 'analyzed' ORDER BY filing_date DESC, filing_id LIMIT 10 OFFSET 20",
    "watched_semi": f"WITH {D_SQL} SELECT id AS company_id, ticker FROM companies c WHERE EXISTS (SELECT 1 FROM dr WHERE dr.company_id = c.id AND cosine > 0.6)",
    "unseen_anti": f"WITH {F_SQL} SELECT filing_id, company_id, status FROM f WHERE NOT EXISTS (SELECT 1 FROM drift_scores d WHERE d.filing_id = f.filing_id)",
    "enrich_left": f"WITH {D_SQL}, g AS (SELECT filing_id, count(*) AS n_scores, round(max(cosine), 6) AS top FROM dr GROUP BY ALL) SELECT filing_id, n_scores, top FROM f LEFT JOIN g USING (filing_id)",
    "forced_rewrite": "SELECT id, drift_score_id FROM sentence_changes s WHERE NOT EXISTS (SELECT 1 FROM drift_scores d WHERE d.id = s.drift_score_id AND d.company_id = 1)",
    "alert_digest": f"WITH {D_SQL}, {_AL}, n AS (SELECT *, row_number() OVER (PARTITION BY severity, company_id ORDER BY created_at DESC, id DESC) AS no FROM al WHERE NOT read) SELECT CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank, severity, company_id, string_agg(id::VARCHAR, ',' ORDER BY no) FILTER (WHERE no <= 5) AS shown, count_if(no > 5)::BIGINT AS more FROM n GROUP BY severity, company_id",
    "alerts_marked_read": f"WITH {D_SQL}, {_AL} SELECT severity, count(*) AS n, count_if(read OR severity = 'low')::BIGINT AS n_read FROM al GROUP BY severity",
    "bridge_alerts": f"WITH {D_SQL}, {_AL} SELECT substring(sic_code, 1, 2) AS watchlist, severity, count(*) AS n, count(DISTINCT company_id) AS companies FROM al JOIN companies c ON c.id = al.company_id WHERE sic_code IS NOT NULL AND NOT read GROUP BY ALL",
    "json_delta": "SELECT id, " + ", ".join(f"TRY_CAST(CASE WHEN json_valid(sentiment_delta) THEN sentiment_delta ->> '$.{k}' END AS DOUBLE) AS {k}" for k in ("negative", "positive", "uncertainty")) + " FROM drift_scores",
    "hash_keys": "SELECT id, substring(sha256('intelligence:' || cik || ':' || id), 1, 24) AS key, created_at + INTERVAL 24 HOURS < TIMESTAMP '2021-01-01' AS expired FROM companies",
    "quarter_math": f"WITH {F_SQL}, {_PREV} SELECT filing_id, year(filing_date) || '-Q' || quarter(filing_date) AS quarter, ((year(filing_date) * 4 + quarter(filing_date)) - (year(prev_date) * 4 + quarter(prev_date)))::INT AS quarters_apart, greatest(1, round_even(abs(datediff('day', prev_date, filing_date)) / 91.0, 0))::INT AS quarters_rounded FROM pv WHERE prev_date IS NOT NULL",
    "retrain_trigger": f"WITH {F_SQL} SELECT count(*) AS n_analyzed, datediff('day', max(filing_date), DATE '2026-06-01')::INT AS days, count(*) >= 100 OR datediff('day', max(filing_date), DATE '2026-06-01') > 30 AS retrain FROM f WHERE status = 'analyzed'",
    "ingest_new": f"WITH {F_SQL} SELECT filing_id, accession FROM f WHERE form = '10-K' AND NOT EXISTS (SELECT 1 FROM f g WHERE g.accession = f.accession AND g.status = 'analyzed')",
    "next_filing": f"WITH {F_SQL} SELECT filing_id, lead(filing_id) OVER (PARTITION BY company_id ORDER BY filing_date, filing_id) AS next_filing_id FROM f",
    "dashboard": f"WITH {D_SQL}, {_AL} SELECT severity, count_if(NOT read)::BIGINT AS unread, count(DISTINCT company_id) AS companies FROM al GROUP BY severity",
    "status_rollup": f"WITH {F_SQL} SELECT form, status, count(*) AS n, min(filing_date) AS first_date FROM f GROUP BY ROLLUP (form, status)",
}
