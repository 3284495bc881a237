"""Views that many queries share, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def clean_filings(spark: SparkSession, base: str) -> DataFrame:
    """(filing_id, company_id, form, filing_date, status, accession): each filing once, forms in normal form."""
    rows = table(spark, base, "filings", "id", "company_id", "form_type", "filing_date", "status", "accession_number")
    once = rows.groupBy("id").agg(*[F.min(c).alias(c) for c in rows.columns[1:]])
    return once.select(F.col("id").alias("filing_id"), "company_id", F.upper(F.trim("form_type")).alias("form"), "filing_date", "status", F.regexp_replace("accession_number", "-", "").alias("accession"))


def clean_sections(spark: SparkSession, base: str, *more: str) -> DataFrame:
    """(section_id, filing_id, company_id, form, filing_date, section): of rows stored again the last."""
    rows = table(spark, base, "sections", "id", "filing_id", "section_type", *more).withColumn("section", F.lower("section_type"))
    last = rows.groupBy("filing_id", "section").agg(F.max("id").alias("id"))
    kept = rows.join(last, ["filing_id", "section", "id"], "left_semi")
    return kept.join(clean_filings(spark, base), "filing_id").select(F.col("id").alias("section_id"), "filing_id", "company_id", "form", "filing_date", "section", *more)


def section_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Each section with its predecessor: same company, form and section, the latest earlier date; both texts not blank."""
    s = clean_sections(spark, base, "section_text").where("section_text is not null and trim(section_text) <> ''")
    before = Window.partitionBy("company_id", "form", "section").orderBy(F.unix_date("filing_date")).rangeBetween(Window.unboundedPreceding, -1)
    keyed = s.select("section_id", "company_id", "form", "section", "filing_date", "filing_id").withColumn("prev", F.max(F.struct("filing_date", "filing_id", "section_id")).over(before)).where("prev is not null")
    texts = s.select("section_id", "section_text")
    return (
        keyed.select("company_id", "form", "section", "filing_date", "section_id", F.col("prev.section_id").alias("prev_id"))
        .join(texts.withColumnRenamed("section_text", "text"), "section_id")
        .join(texts.select(F.col("section_id").alias("prev_id"), F.col("section_text").alias("prev_text")), "prev_id")
        .select("company_id", "section", "section_id", "prev_id", "text", "prev_text")
    )


def clean_drift(spark: SparkSession, base: str) -> DataFrame:
    """Drift scores with dates: of rows written again the last, values that cannot be true as null."""
    rows = table(spark, base, "drift_scores", "id", "company_id", "filing_id", "section_type", "cosine_distance", "jaccard_distance", "added_words", "removed_words", "sentiment_delta", "computed_at").withColumn("section", F.lower(F.trim("section_type")))
    last = rows.groupBy("filing_id", "section").agg(F.max("id").alias("id"))
    kept = rows.join(last, ["filing_id", "section", "id"], "left_semi")
    true = lambda c, top: F.when(~F.isnan(c) & F.col(c).between(-0.000001, top), F.col(c))
    return kept.join(clean_filings(spark, base).select("filing_id", "form", "filing_date"), "filing_id").select("id", "company_id", "filing_id", "section", "form", "filing_date", true("cosine_distance", 2.000001).alias("cosine"), true("jaccard_distance", 1.000001).alias("jaccard"), "added_words", "removed_words", "sentiment_delta", "computed_at")


F_SQL = "f AS (SELECT id AS filing_id, min(company_id) AS company_id, upper(trim(min(form_type))) AS form, min(filing_date) AS filing_date, min(status) AS status, replace(min(accession_number), '-', '') AS accession FROM filings GROUP BY id)"
S_SQL = F_SQL + ", cs AS (SELECT s.id AS section_id, s.filing_id, f.company_id, f.form, f.filing_date, lower(s.section_type) AS section, s.section_text, s.embedding FROM (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY filing_id, lower(section_type) ORDER BY id DESC) = 1) s JOIN f USING (filing_id))"
P_SQL = S_SQL + ", st AS (SELECT * FROM cs WHERE section_text IS NOT NULL AND trim(section_text) <> ''), pr AS (SELECT a.company_id, a.section, a.section_id, b.section_id AS prev_id, a.section_text AS text, b.section_text AS prev_text FROM st a JOIN st b ON a.company_id = b.company_id AND a.form = b.form AND a.section = b.section AND b.filing_date < a.filing_date QUALIFY row_number() OVER (PARTITION BY a.section_id ORDER BY b.filing_date DESC, b.filing_id DESC, b.section_id DESC) = 1)"
D_SQL = F_SQL + ", dr AS (SELECT d.id, d.company_id, d.filing_id, lower(trim(d.section_type)) AS section, f.form, f.filing_date, CASE WHEN NOT isnan(cosine_distance) AND cosine_distance BETWEEN -0.000001 AND 2.000001 THEN cosine_distance END AS cosine, CASE WHEN NOT isnan(jaccard_distance) AND jaccard_distance BETWEEN -0.000001 AND 1.000001 THEN jaccard_distance END AS jaccard, added_words, removed_words, sentiment_delta, computed_at FROM (SELECT * FROM drift_scores QUALIFY row_number() OVER (PARTITION BY filing_id, lower(trim(section_type)) ORDER BY id DESC) = 1) d JOIN f USING (filing_id))"


def tok_sql(x: str) -> str:
    """The words of ``x`` in DuckDB, whose boundaries know ASCII only."""
    w = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
    return (
        f"flatten(list_transform(regexp_extract_all({x}, '{w}+(?:''{w}+)?'), lambda t: CASE WHEN regexp_full_match(t, '[a-zA-Z]+(''[a-zA-Z]+)?') THEN [lower(t)] "
        f"ELSE list_filter([lower(split_part(t, '''', 1)), lower(split_part(t, '''', 2))], lambda u: regexp_full_match(u, '[a-zA-Z]+')) END))"
    )


_SP = r"[\s\x0b\x85\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def naive_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?]){_SP}+([A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: {strip_sql('s')}), lambda s: s <> '')"


def sent_sql(x: str) -> str:
    from tidemark.functions.text import _AB

    a = f"regexp_replace({x}, '((?:[A-Z]\\.)(?:[A-Z]\\.)+)', chr(3) || '\\1' || chr(4), 'g')"
    b = f"regexp_replace({a}, '({_AB})\\.', chr(3) || '\\1' || chr(1), 'g')"
    c = f"regexp_replace({b}, '([.!?]){_SP}+([A-Z])', '\\1' || chr(2) || '\\2', 'g')"
    clean = "replace(replace(replace(s, chr(3), ''), chr(4), ''), chr(1), '.')"
    return f"list_filter(list_transform(string_split({c}, chr(2)), lambda s: {strip_sql(clean)}), lambda s: s <> '')"


def words_sql(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def values_sql(rows: list[tuple]) -> str:
    """Rows as a VALUES list."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
