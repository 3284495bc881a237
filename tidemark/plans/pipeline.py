"""The analysis of filings as one job, its sinks and triggers, and the smaller views of the application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lexicons import SAMPLE_SOFT, SAMPLE_WATCH
from tidemark.operators import lexical as L
from tidemark.operators import relational as R
from tidemark.operators import sentences as N
from tidemark.operators import series as S
from tidemark.plans import relational, series, sentences, texts
from tidemark.plans.series import CRITICAL
from tidemark.plans.views import D_SQL, F_SQL, P_SQL, S_SQL, clean_drift, clean_filings, clean_sections, section_pairs
from tidemark.session import scratch, stored
from tidemark.sources.files import rewrite
from tidemark.sources.tables import table
from tidemark.streaming import events as E


def _section_alerts(spark: SparkSession, base: str, pairs: DataFrame) -> DataFrame:
    ids = clean_sections(spark, base).select("section_id", "filing_id", "section")
    level = S.company_anomaly(S.base(clean_drift(spark, base))).select("filing_id", "section", "level").join(ids, ["filing_id", "section"]).join(pairs.select("section_id"), "section_id", "left_semi")
    critical = N.exact_changes(N.pair_sentences(pairs)).where(N.has_any(F.lower("sentence"), CRITICAL)).groupBy("section_id").agg(F.count("*").alias("n_critical"))
    phrases = L.watch_changes(pairs, SAMPLE_WATCH).where("status <> 'persisted'").groupBy("section_id").agg(F.count("*").alias("n_phrases"))
    harder = L.obfuscation(pairs, SAMPLE_SOFT).select("section_id", F.col("obfuscation").alias("score"))
    return R.alerts(level, critical, phrases, harder)


def section_alerts(spark: SparkSession, base: str) -> DataFrame:
    """The four alert rules over each section and its predecessor."""
    return _section_alerts(spark, base, section_pairs(spark, base))


def analysed(spark: SparkSession, base: str, pairs: DataFrame) -> dict[str, DataFrame]:
    """The four tables that the analysis of some pairs of sections fills."""
    return {
        "drift_scores": L.jaccard_drift(pairs.select("section_id", "text", "prev_text")),
        "sentence_changes": N.exact_changes(N.pair_sentences(pairs)).select("section_id", "change", "no", "sentence"),
        "key_phrases": L.watch_changes(pairs, SAMPLE_WATCH),
        "alerts": _section_alerts(spark, base, pairs),
    }


def _sizes(spark: SparkSession, place: str, tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in tables.items():
        n = spark.read.schema(f"{rows.schema.simpleString()[7:-1]},run bigint".replace(":", " ")).parquet(f"{place}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionAll(n)
    return out


def analysis_tables(spark: SparkSession, base: str) -> DataFrame:
    """All sections analysed in one run: four tables are written, a partition for each run, and counted."""
    place = scratch(spark, "analysis")
    tables = analysed(spark, base, stored(section_pairs(spark, base)))
    for name, rows in tables.items():
        rewrite(rows.withColumn("run", F.lit(0).cast("bigint")), f"{place}/{name}", "run")
    return _sizes(spark, place, tables)


def daily_pipeline(spark: SparkSession, base: str) -> DataFrame:
    """The same as a stream of filings: every batch analyses the sections of its new filings and writes the partition of the batch, so a batch that runs again replaces its rows."""
    place = scratch(spark, "daily")
    known = {}

    def run(batch: DataFrame, no: int) -> None:
        new = batch.select(F.col("id").alias("filing_id")).distinct()
        ids = clean_sections(spark, base).select("section_id", "filing_id").join(new, "filing_id", "left_semi").select("section_id")
        for name, rows in analysed(spark, base, stored(section_pairs(spark, base).join(ids, "section_id", "left_semi"))).items():
            known[name] = rows
            rewrite(rows.withColumn("run", F.lit(no).cast("bigint")), f"{place}/{name}", "run")

    stream = E.stream(spark, base, "filings").select("id")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(run).start().awaitTermination()
    return _sizes(spark, place, known)


def rolling_stream(spark: SparkSession, base: str) -> DataFrame:
    """The index of the newest sentences, kept as sentences arrive: each batch joins what is held and the oldest fall out."""
    place = scratch(spark, "rolling")
    state = {"at": None}

    def run(batch: DataFrame, no: int) -> None:
        held = batch if state["at"] is None else batch.unionByName(spark.read.parquet(state["at"]))
        N.rolling_index(held.dropDuplicates(["id"]), "id").write.mode("overwrite").parquet(f"{place}/index-{no}")
        state["at"] = f"{place}/index-{no}"

    stream = E.stream(spark, base, "sentence_changes").select("id", "sentence_text")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(run).start().awaitTermination()
    return spark.read.parquet(state["at"]).select("id", F.md5("sentence_text").alias("sentence_hash"))


def retrain_counter(spark: SparkSession, base: str) -> DataFrame:
    """Filings counted by status as they arrive, and whether a hundred analysed ones call for training."""
    counted = E.stream(spark, base, "filings").select("status", "accession_number").groupBy("status").agg(F.count("*").alias("n"))
    return E.drained(counted, "complete").select("status", "n", ((F.col("status") == "analyzed") & (F.col("n") >= 100)).alias("retrain"))


def retrain_first(spark: SparkSession, base: str) -> DataFrame:
    """Whether companies whose filings were never trained on have enough of them for a first training (ten)."""
    f = clean_filings(spark, base).where("status = 'analyzed'").groupBy("company_id").agg(F.count("*").alias("n_analyzed"))
    return f.select("company_id", "n_analyzed", (F.col("n_analyzed") >= 10).alias("retrain"))


def cache_swept(spark: SparkSession, base: str) -> DataFrame:
    """Cached entries that are still valid after a sweep: kept for a year from when they came in, as of the newest entry."""
    d = table(spark, base, "documents", "doc_id", "source", "ingested_at").where("ingested_at is not null")
    now = d.agg(F.max("ingested_at").alias("now"))
    keyed = d.select("doc_id", R.cache_key(F.lit("doc"), F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("key"), (F.col("ingested_at") + F.expr("INTERVAL 365 DAYS")).alias("expires_at"))
    return keyed.join(F.broadcast(now), F.col("expires_at") > F.col("now")).select("doc_id", "key", "expires_at")  # one row


def watchlist_after(spark: SparkSession, base: str) -> DataFrame:
    """The bridge of watched companies after the companies without a ticker were taken out and those of sector 73 put in, each pair once."""
    c = table(spark, base, "companies", "id", "ticker", "sic_code")
    bridge = c.where("sic_code is not null").select(F.substring("sic_code", 1, 2).alias("watchlist"), F.col("id").alias("company_id"))
    kept = bridge.join(c.where("ticker is null or trim(ticker) = ''").select(F.col("id").alias("company_id")), "company_id", "left_anti").select("watchlist", "company_id")
    new = c.where("substring(sic_code, 1, 2) = '73'").select(F.lit("watched").alias("watchlist"), F.col("id").alias("company_id"))
    return kept.unionAll(new).distinct()


def ingest_report(spark: SparkSession, base: str) -> DataFrame:
    """What the ingest worker stores: the first 500,000 characters and the new status, and how many filings it skips as known."""
    f = table(spark, base, "filings", "id", "accession_number", "status", "raw_text").withColumn("accession", F.regexp_replace("accession_number", "-", ""))
    g = f.groupBy("accession").agg(F.count_distinct("id").alias("k"), F.max(F.col("status") == "analyzed").alias("known"), F.max(F.length(F.substring("raw_text", 1, 500_000))).alias("chars"))
    return g.groupBy(F.when(F.col("known"), "skipped").otherwise("ingested").alias("outcome")).agg(F.count("*").alias("filings"), F.sum("k").alias("rows"), F.coalesce(F.max("chars"), F.lit(0)).cast("bigint").alias("most_chars"))


def training_section_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Each stored section with the one before it of its company and kind, of those with a hundred words or more: the pairs that training reads."""
    s = clean_sections(spark, base, "word_count").where("word_count >= 100")
    w = Window.partitionBy("company_id", "section").orderBy("filing_date", "filing_id")
    return s.withColumn("prev_id", F.lag("section_id").over(w)).where("prev_id is not null").select("section_id", "prev_id", "company_id", "section")


def top_movers(spark: SparkSession, base: str) -> DataFrame:
    """The five companies of largest latest drift with their last three filings."""
    d = clean_drift(spark, base).where("cosine is not null")
    latest = R.latest_rows(d, ["company_id"], "filing_date").groupBy("company_id").agg(F.round(F.max("cosine"), 6).alias("drift"))
    top = latest.orderBy(F.desc("drift"), "company_id").limit(5)
    w = Window.partitionBy("company_id").orderBy(F.desc("filing_date"), F.desc("filing_id"))
    recent = clean_filings(spark, base).join(F.broadcast(top), "company_id").withColumn("no", F.row_number().over(w)).where("no <= 3")  # five rows
    return recent.select("company_id", "drift", "no", "filing_id", "form", "filing_date")


def phrases_by_date(spark: SparkSession, base: str) -> DataFrame:
    """Watched phrases of each company by date: how many appeared, went and stayed."""
    p = section_pairs(spark, base)
    dates = clean_sections(spark, base).select("section_id", "filing_date")
    w = L.watch_changes(p, SAMPLE_WATCH).join(p.select("section_id", "company_id"), "section_id").join(dates, "section_id")
    return w.groupBy("company_id", "filing_date").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("appeared", "disappeared", "persisted")])


def alert_tabs(spark: SparkSession, base: str) -> DataFrame:
    """Alerts behind each tab: unread, critical and high, whatever the case of the severity."""
    a = relational._alerts(spark, base)
    tabs = {"all": F.lit(True), "unread": ~F.col("read"), "critical": F.lower("severity") == "critical", "high": F.lower("severity") == "high"}
    rows = a.select(F.explode(F.array(*[F.when(v, F.lit(k)) for k, v in tabs.items()])).alias("tab"), "company_id").where("tab is not null")
    return rows.groupBy("tab").agg(F.count("*").alias("n"), F.count_distinct("company_id").alias("companies"))


def quadratic_extrapolation(spark: SparkSession, base: str) -> DataFrame:
    """Least squares parabola of each series of four values or more and its value one step ahead, by the normal equations over centred positions."""
    s = S.base(clean_drift(spark, base)).where("n >= 4").withColumn("x", F.col("i") - (F.col("n") + 1) / 2.0)
    x, y = F.col("x"), F.col("cosine")
    g = s.groupBy("company_id", "section").agg(F.count("*").alias("k"), F.sum(x * x).alias("s2"), F.sum(x * x * x * x).alias("s4"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x * y).alias("sxxy"))
    c = F.col
    # odd sums of centred positions vanish, so the line and the parabola part
    curve = (c("k") * c("sxxy") - c("s2") * c("sy")) / (c("k") * c("s4") - c("s2") * c("s2"))
    ahead = (c("k") + 1) / 2.0
    g = g.withColumn("curve", curve)
    value = (c("sy") - c("curve") * c("s2")) / c("k") + c("sxy") / c("s2") * ahead + c("curve") * ahead * ahead
    return g.select("company_id", "section", F.round("curve", 9).alias("curve"), F.round(value, 9).alias("next"))


QUERIES = {
    f.__name__: f
    for f in (
        section_alerts, analysis_tables, daily_pipeline, rolling_stream, retrain_counter, retrain_first, cache_swept, watchlist_after, ingest_report, training_section_pairs, top_movers, phrases_by_date, alert_tabs,
        quadratic_extrapolation,
    )
}

_CRIT = " OR ".join(f"contains(lower(sentence), '{x}')" for x in CRITICAL)
_ALERTS = f"""WITH {S_SQL}, {P_SQL.replace(S_SQL + ', ', '')}, {series._SE.replace(F_SQL + ', ', '')}, {series._CA}, {sentences._PS}, pn AS (SELECT *, {sentences._NORM} AS norm FROM ps),
s1 AS (SELECT cs.section_id, {series._level('z', 'NULL', 'cosine')} AS level FROM ca JOIN cs USING (filing_id, section) WHERE cs.section_id IN (SELECT section_id FROM pr)),
s2 AS (SELECT section_id, count(*) AS n FROM pn a WHERE ({_CRIT}) AND NOT EXISTS (SELECT 1 FROM pn b WHERE b.section_id = a.section_id AND b.side = 1 - a.side AND b.norm = a.norm) GROUP BY ALL),
s3 AS (SELECT section_id, count(*) AS n FROM ({texts.SQL['watch_phrase_changes']}) WHERE status <> 'persisted' GROUP BY ALL),
s4 AS (SELECT section_id FROM ({texts.SQL['pair_obfuscation']}) WHERE obfuscation > 0.5)
SELECT section_id, 'drift_anomaly' AS alert_type, CASE level WHEN 'extreme' THEN 'critical' WHEN 'high' THEN 'high' ELSE 'medium' END AS severity, 'drift is ' || level AS message FROM s1 WHERE level <> 'normal'
UNION ALL SELECT section_id, 'critical_risk_language', 'critical', n || ' critical sentences' FROM s2 UNION ALL SELECT section_id, 'phrase_change', 'high', n || ' watched phrases changed' FROM s3
UNION ALL SELECT section_id, 'obfuscation_detected', 'high', 'harder to read' FROM s4"""
_COUNTS = f"SELECT 'drift_scores' AS table_name, count(*) AS n FROM ({texts.SQL['pair_jaccard_drift']}) UNION ALL SELECT 'sentence_changes', count(*) FROM ({sentences.SQL['sentence_exact_changes']}) UNION ALL SELECT 'key_phrases', count(*) FROM ({texts.SQL['watch_phrase_changes']}) UNION ALL SELECT 'alerts', count(*) FROM ({_ALERTS})"

SQL = {
    "section_alerts": _ALERTS,
    "analysis_tables": _COUNTS,
    "daily_pipeline": _COUNTS,
    "rolling_stream": sentences.SQL["rolling_sentences"],
    "retrain_counter": "SELECT status, count(*) AS n, status = 'analyzed' AND count(*) >= 100 AS retrain FROM filings GROUP BY status",
    "retrain_first": f"WITH {F_SQL} SELECT company_id, count(*) AS n_analyzed, count(*) >= 10 AS retrain FROM f WHERE status = 'analyzed' GROUP BY company_id",
    "cache_swept": "SELECT doc_id, substring(sha256('doc:' || coalesce(source, '') || ':' || doc_id), 1, 24) AS key, ingested_at + INTERVAL 365 DAYS AS expires_at FROM documents WHERE ingested_at + INTERVAL 365 DAYS > (SELECT max(ingested_at) FROM documents)",
    "watchlist_after": "SELECT substring(sic_code, 1, 2) AS watchlist, id AS company_id FROM companies WHERE sic_code IS NOT NULL AND ticker IS NOT NULL AND trim(ticker) <> '' UNION SELECT 'watched', id FROM companies WHERE substring(sic_code, 1, 2) = '73'",
    "ingest_report": "WITH g AS (SELECT replace(accession_number, '-', '') AS accession, count(DISTINCT id) AS k, bool_or(status = 'analyzed') AS known, max(length(substring(raw_text, 1, 500000))) AS chars FROM filings GROUP BY 1) SELECT CASE WHEN known THEN 'skipped' ELSE 'ingested' END AS outcome, count(*) AS filings, sum(k)::BIGINT AS rows, coalesce(max(chars), 0)::BIGINT AS most_chars FROM g GROUP BY 1",
    "training_section_pairs": f"WITH {S_SQL.replace('s.section_text, s.embedding', 's.word_count')}, w AS (SELECT section_id, lag(section_id) OVER (PARTITION BY company_id, section ORDER BY filing_date, filing_id) AS prev_id, company_id, section FROM cs WHERE word_count >= 100) SELECT section_id, prev_id, company_id, section FROM w WHERE prev_id IS NOT NULL",
    "top_movers": f"WITH {D_SQL}, m AS (SELECT company_id, round(max(cosine), 6) AS drift FROM (SELECT * FROM dr WHERE cosine IS NOT NULL QUALIFY filing_date = max(filing_date) OVER (PARTITION BY company_id)) GROUP BY 1 ORDER BY drift DESC, company_id LIMIT 5), r AS (SELECT f.company_id, drift, row_number() OVER (PARTITION BY f.company_id ORDER BY filing_date DESC, filing_id DESC)::INT AS no, filing_id, form, filing_date FROM f JOIN m USING (company_id)) SELECT * FROM r WHERE no <= 3",
    "phrases_by_date": f"WITH {S_SQL}, w AS ({texts.SQL['watch_phrase_changes']}) SELECT company_id, filing_date, count_if(status = 'appeared')::BIGINT AS appeared, count_if(status = 'disappeared')::BIGINT AS disappeared, count_if(status = 'persisted')::BIGINT AS persisted FROM w JOIN cs USING (section_id) GROUP BY ALL",
    "alert_tabs": f"WITH {D_SQL}, {relational._AL}, t AS (SELECT unnest([CASE WHEN true THEN 'all' END, CASE WHEN NOT read THEN 'unread' END, CASE WHEN severity = 'critical' THEN 'critical' END, CASE WHEN severity = 'high' THEN 'high' END]) AS tab, company_id FROM al) SELECT tab, count(*) AS n, count(DISTINCT company_id) AS companies FROM t WHERE tab IS NOT NULL GROUP BY tab",
    "quadratic_extrapolation": f"WITH {series._SE}, q AS (SELECT company_id, section, cosine AS y, i - (n + 1) / 2.0::DOUBLE AS x FROM se WHERE n >= 4), g AS (SELECT company_id, section, count(*) AS k, sum(x * x) AS s2, sum(x ** 4) AS s4, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x * y) AS sxxy FROM q GROUP BY ALL), h AS (SELECT *, (k * sxxy - s2 * sy) / (k * s4 - s2 * s2) AS c, (k + 1) / 2.0::DOUBLE AS a FROM g) SELECT company_id, section, round(c, 9) AS curve, round((sy - c * s2) / k + sxy / s2 * a + c * a * a, 9) AS next FROM h",
}
