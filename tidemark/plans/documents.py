"""Queries on markup, filing sections and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions.filings import LEADING_ITEM, NOTHING, POINTER
from tidemark.plans.views import clean_sections, section_pairs, words_sql
from tidemark.sources.tables import table


def html_clean_regex(spark: SparkSession, base: str) -> DataFrame:
    """Tags and entities taken out by expressions alone."""
    d = table(spark, base, "documents", "doc_id", "text").where("text is not null")
    bare = F.regexp_replace(F.regexp_replace("text", "<[^<>]{1,200}>", " "), "&quot;", '"')
    return d.select("doc_id", F.md5(F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))).alias("text_hash"))


def html_clean(spark: SparkSession, base: str) -> DataFrame:
    """Every text cleaned of markup and entities by a parser."""
    d = table(spark, base, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", D.plain_text_col(F.col("text")).alias("text"))


def html_sections(spark: SparkSession, base: str) -> DataFrame:
    """Sections found inside stored texts by the headings of their filing's form."""
    s = clean_sections(spark, base, "section_text").where("section_text is not null")
    return s.select("section_id", F.inline(D.sections_col(F.col("section_text"), F.col("form")))).select("section_id", F.col("section").alias("found"), F.length("body").alias("n_chars"))


def filing_sections(spark: SparkSession, base: str) -> DataFrame:
    """Documents put together from the stored sections of each filing, under marked headings, and parsed again: (filing_id, section, n_words) of what comes out."""
    s = clean_sections(spark, base, "section_text").where("section_text is not null")
    block = F.concat(F.lit('<div><ix:nonNumeric name="us-gaap:'), tag_of(F.col("section")), F.lit('">'), F.regexp_replace(F.regexp_replace("section_text", "&", "&amp;"), "<", "&lt;"), F.lit("</ix:nonNumeric></div>"))
    html = s.where(tag_of(F.col("section")).isNotNull()).groupBy("filing_id", "form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", block.alias("b")))), lambda x: x["b"]), "\n").alias("html"))
    found = html.select("filing_id", F.inline(D.filing_col(F.col("html"), F.col("form"))))
    return found.select("filing_id", "section", F.size(F.filter(F.split("body", "[ \\t\\r\\n]+"), lambda w: w != "")).alias("n_words"))


def tag_of(section: Column) -> Column:
    """The inline tag of a section's name; null for a name without one."""
    from tidemark.functions.filings import INLINE

    names = {s: k for k, s in INLINE.items() if k.endswith("TextBlock")}
    return F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), section)


def text_diff(spark: SparkSession, base: str) -> DataFrame:
    p = section_pairs(spark, base)
    return p.select("section_id", D.diff_col(F.col("prev_text"), F.col("text")).alias("d")).select("section_id", "d.*")


def cross_reference_stubs(spark: SparkSession, base: str) -> DataFrame:
    """Short sections that only point elsewhere, by expressions alone."""
    s = clean_sections(spark, base, "section_text").where("section_text is not null")
    words = F.size(F.filter(F.split("section_text", "\\s+"), lambda w: w != ""))
    return s.where(D.stub_col(F.col("section_text"))).select("section_id", words.alias("n_words"))


QUERIES = {f.__name__: f for f in (html_clean_regex, html_clean, html_sections, filing_sections, text_diff, cross_reference_stubs)}

_WORDS = "len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"

SQL = {
    "html_clean_regex": "SELECT doc_id, md5(trim(regexp_replace(replace(regexp_replace(text, '<[^<>]{1,200}>', ' ', 'g'), '&quot;', '\"'), '[ \\t\\r\\n]+', ' ', 'g'))) AS text_hash FROM documents WHERE text IS NOT NULL",
    "cross_reference_stubs": f"WITH c AS (SELECT s.id AS section_id, section_text AS t, {_WORDS.format(x='section_text')}::INT AS n_words, trim(regexp_replace(regexp_replace(section_text, '^\\s+|\\s+$', '', 'g'), '{LEADING_ITEM}', '', 'i')) AS body FROM (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY filing_id, lower(section_type) ORDER BY id DESC) = 1) s JOIN (SELECT DISTINCT id AS filing_id FROM filings) f USING (filing_id) WHERE section_text IS NOT NULL) SELECT section_id, n_words FROM c WHERE n_words < 200 AND (regexp_replace(lower(body), '\\.+$', '') IN {words_sql(list(NOTHING))} OR regexp_matches(t, '{POINTER.replace('.*?', '[^\\n]*?')}', 'i') OR {_WORDS.format(x='body')} < 20 AND NOT list_bool_or(list_transform(regexp_split_to_array(body, '[.!?]'), lambda s: {_WORDS.format(x='s')} >= 10)))",
}
