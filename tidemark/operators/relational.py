"""Set-based operators over companies, filings, scores and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def padded_cik(c: Column) -> Column:
    return F.lpad(F.trim(c), 10, "0")


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    """Path of a filing's document: the number without leading zeros, the accession without dashes."""
    return F.concat(F.lit("https://filings.example/"), F.regexp_replace(cik, "^0+", ""), F.lit("/"), F.regexp_replace(accession, "-", ""), F.lit("/"), document)


def zipped_rows(metadata: DataFrame, arrays: list[str], forms: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of parallel arrays zipped by position; shorter arrays give nulls, empty dates are null.

    A form list and an inclusive date range narrow the rows; the range applies
    to rows that have a date.
    """
    keys = [c for c in metadata.columns if c not in arrays]
    rows = metadata.select(*keys, F.inline(F.arrays_zip(*arrays)))
    rows = rows.withColumn("filing_date", F.try_to_date(F.nullif(F.col("filing_date"), F.lit(""))))
    if forms is not None:
        rows = rows.where(F.col("form").isin(forms))
    if start is not None:
        rows = rows.where(F.col("filing_date").isNull() | (F.col("filing_date") >= F.lit(start).cast("date")))
    if end is not None:
        rows = rows.where(F.col("filing_date").isNull() | (F.col("filing_date") <= F.lit(end).cast("date")))
    return rows


def search_companies(companies: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Companies whose ticker or name contains ``query`` in any case, by id."""
    q = query.strip().upper()
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    hit = F.contains(F.upper("ticker"), F.lit(q)) | F.contains(F.upper("name"), F.lit(q))
    return companies.where(hit).orderBy("id").limit(limit)


def lookup(companies: DataFrame, ticker: str) -> DataFrame:
    """The companies of a ticker of 1 to 10 letters and digits."""
    import re

    if not re.fullmatch(r"[A-Za-z0-9]{1,10}", ticker):
        raise ValueError("invalid ticker")
    return companies.where(F.upper("ticker") == ticker.upper())


def previous_filing(filings: DataFrame) -> DataFrame:
    """Each filing with the latest one of the same company and form of a strictly earlier date (the larger id of one day)."""
    w = Window.partitionBy("company_id", "form").orderBy(F.unix_date("filing_date")).rangeBetween(Window.unboundedPreceding, -1)
    prev = F.max(F.struct("filing_date", "filing_id")).over(w)
    return filings.withColumn("p_", prev).select(*filings.columns, F.col("p_.filing_id").alias("prev_filing_id"), F.col("p_.filing_date").alias("prev_date")).drop("p_")


def latest_rows(rows: DataFrame, group: list[str], by: str) -> DataFrame:
    """Rows that hold the latest value of their group; ties are kept."""
    top = rows.groupBy(*group).agg(F.max(by).alias("top_"))
    return rows.join(top, group).where(F.col(by) == F.col("top_")).drop("top_")


SORTS = ("cosine", "jaccard", "added_words", "removed_words")


def screener(drift: DataFrame, companies: DataFrame, sort_by: str = "cosine", section: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of each company's latest scores, the largest first; an unknown sort column falls back to the first."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be from 1 to 200, offset not negative")
    sort_by = sort_by if sort_by in SORTS else SORTS[0]
    rows = latest_rows(drift, ["company_id"], "computed_at")
    if section is not None:
        rows = rows.where(F.col("section") == section)
    shown = lambda c: F.when(F.col(c) != 0, F.round(c, 4))
    joined = rows.join(companies.select(F.col("id").alias("company_id"), "ticker"), "company_id")
    ordered = joined.orderBy(F.desc_nulls_last(sort_by), "id").offset(offset).limit(limit)
    return ordered.select("id", "company_id", "ticker", "section", "filing_date", shown("cosine").alias("cosine"), shown("jaccard").alias("jaccard"), "added_words", "removed_words")


def alerts(scores: DataFrame, changes: DataFrame, phrases: DataFrame, obfuscation: DataFrame) -> DataFrame:
    """The four alert rules as one table (section_id, alert_type, severity, message).

    ``scores`` has (section_id, level), ``changes`` (section_id, n_critical),
    ``phrases`` (section_id, n_phrases), ``obfuscation`` (section_id, score).
    """
    severity = F.when(F.col("level") == "extreme", "critical").when(F.col("level") == "high", "high").otherwise("medium")
    one = scores.where("level <> 'normal'").select("section_id", F.lit("drift_anomaly").alias("alert_type"), severity.alias("severity"), F.concat(F.lit("drift is "), F.col("level")).alias("message"))
    two = changes.where("n_critical > 0").select("section_id", F.lit("critical_risk_language"), F.lit("critical"), F.format_string("%d critical sentences", "n_critical"))
    three = phrases.where("n_phrases > 0").select("section_id", F.lit("phrase_change"), F.lit("high"), F.format_string("%d watched phrases changed", "n_phrases"))
    four = obfuscation.where("score > 0.5").select("section_id", F.lit("obfuscation_detected"), F.lit("high"), F.lit("harder to read"))
    return one.unionAll(two).unionAll(three).unionAll(four)


def digest(alerts: DataFrame, k: int = 5) -> DataFrame:
    """Unread alerts by severity and company: the newest ``k`` with a count of the rest.

    (severity_rank, severity, company_id, shown, more); ``shown`` lists the ids, the newest first.
    """
    rank = F.create_map(*[F.lit(x) for p in (("critical", 0), ("high", 1), ("medium", 2), ("low", 3)) for x in p])
    w = Window.partitionBy("severity", "company_id").orderBy(F.desc("created_at"), F.desc("id"))
    rows = alerts.where("not read").withColumn("no", F.row_number().over(w))
    grouped = rows.groupBy("severity", "company_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("no") <= k, F.struct("no", "id")))), lambda x: x["id"].cast("string")), ",").alias("shown"),
        F.sum((F.col("no") > k).cast("bigint")).alias("more"),
    )
    return grouped.select(F.coalesce(rank[F.col("severity")], F.lit(99)).alias("severity_rank"), "severity", "company_id", "shown", "more")


def rewritten(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """The table without the rows of ``doomed``: the first half of a delete-then-rewrite."""
    return rows.join(doomed.select(key), key, "left_anti")


def marked_read(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """Alerts with ``read`` set where their id is listed."""
    seen = ids.select(F.col("id"), F.lit(True).alias("seen_")).distinct()
    return alerts.join(seen, "id", "left").withColumn("read", F.coalesce("seen_", "read")).drop("seen_")


def cache_key(*parts: Column) -> Column:
    """A prefix and the first 24 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 24)


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d), F.lit("-Q"), F.quarter(d))


def quarter_number(d: Column) -> Column:
    return F.year(d) * 4 + F.quarter(d) - 1


def quarters_between(a: Column, b: Column) -> Column:
    """Whole quarters of 91 days between two dates, one at least, halves to even."""
    return F.greatest(F.lit(1), F.bround(F.abs(F.datediff(b, a)) / 91).cast("int"))


def json_number(c: Column, key: str) -> Column:
    """A number of a JSON object; null where the text is no object or lacks the key."""
    return F.get_json_object(c, f"$.{key}").try_cast("double")
