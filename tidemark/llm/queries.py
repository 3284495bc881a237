"""Queries p1 to p9 of the corpus operators, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chunking import text_pieces
from tidemark.llm.langid import misfits, stretches
from tidemark.llm.leaks import leaked_items
from tidemark.llm.nearcopies import all_pairs, classes, near_copies
from tidemark.llm.neighbours import nearest
from tidemark.llm.packing import packed
from tidemark.llm.segment import sentence_units
from tidemark.llm.spans import shared_stretches
from tidemark.session import stored
from tidemark.sources.tables import table


def records(spark: SparkSession, base: str) -> DataFrame:
    """Sections and sentence changes as (record_kind, record_id, text)."""
    sections = table(spark, base, "sections").select(F.lit("section").alias("record_kind"), F.col("id").alias("record_id"), F.col("section_text").alias("text"))
    changes = table(spark, base, "sentence_changes").select(F.lit("sentence").alias("record_kind"), F.col("id").alias("record_id"), F.col("sentence_text").alias("text"))
    return sections.unionAll(changes)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return sentence_units(records(spark, base), "record_kind", "record_id", "text")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    links, members = near_copies(records(spark, base), "record_kind", "record_id", "text")
    return all_pairs(links, members).select(F.col("kind").alias("record_kind"), F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"))


def p2_groups(spark: SparkSession, base: str) -> DataFrame:
    """Every record with its class of near copies, its copies and its number of links."""
    given = records(spark, base)
    links, members = near_copies(given, "record_kind", "record_id", "text")
    found = classes(given, "record_kind", "record_id", stored(links), members)
    return found.select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "class_id", "copies", "links")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    found = shared_stretches(table(spark, base, "sections", "id", "section_text"), "id", "section_text")
    return found.select(F.col("id").alias("section_id"), "start_pos", "end_pos")


def p4_shared_share(spark: SparkSession, base: str) -> DataFrame:
    """For each section how much of its text stands elsewhere too."""
    sections = table(spark, base, "sections", "id", "section_text")
    held = p4_found(spark, base).groupBy("section_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    return (
        sections.groupBy(F.col("id").alias("section_id")).agg(F.max(F.length("section_text")).cast("bigint").alias("n_chars"))
        .join(held, "section_id", "left")
        .select("section_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
        .withColumn("shared_share", F.round(F.expr("coalesce(try_divide(shared_chars, n_chars), 0.0d)"), 6))
    )


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    near = nearest(table(spark, base, "sections", "id", "embedding"), "id", "embedding")
    return near.select(F.least("id", "other").alias("section_id_a"), F.greatest("id", "other").alias("section_id_b")).distinct()


def p5_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """Ranked neighbours of the stated query set: every section whose id is divisible by 20."""
    near = nearest(table(spark, base, "sections", "id", "embedding"), "id", "embedding")
    return near.where("id % 20 = 0").select(F.col("id").alias("section_id"), F.col("other").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"), "rank")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_pieces(spark, base).where("piece_no = 0").select("section_id", "cut_kind")


def p6_pieces(spark: SparkSession, base: str) -> DataFrame:
    return text_pieces(table(spark, base, "sections", "id", "section_text"), "id", "section_text").withColumnRenamed("key", "section_id")


def p7_packed(spark: SparkSession, base: str) -> DataFrame:
    return packed(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p7_variable(spark: SparkSession, base: str) -> DataFrame:
    """The same with several permitted lengths, chosen jointly."""
    return packed(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text", (512, 1024, 2048)).withColumnRenamed("key", "doc_id")


def _leaks(spark: SparkSession, base: str) -> DataFrame:
    return leaked_items(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text", table(spark, base, "eval_items", "item_id", "text"), "item_id", "text")


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return _leaks(spark, base).where("passage and shared_windows > 0").select("doc_id", "item_id")


def p8_report(spark: SparkSession, base: str) -> DataFrame:
    """Per test item: documents it leaked into and the largest share any of them holds."""
    return _leaks(spark, base).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.sum((F.col("shared_windows") > 0).cast("bigint")).alias("n_exact"), F.round(F.max("item_share"), 6).alias("max_share"))


def _stretches(spark: SparkSession, base: str) -> DataFrame:
    return stretches(table(spark, base, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang")


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return misfits(_stretches(spark, base)).select(F.col("id").alias("doc_id"), "start_pos", "lang_code")


def p9_languages(spark: SparkSession, base: str) -> DataFrame:
    """Every stretch of every document with its language and the confidence in it."""
    return _stretches(spark, base).select(F.col("id").alias("doc_id"), "start_pos", "end_pos", "lang_code", F.round("confidence", 4).alias("confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_groups, p4_found, p4_shared_share, p5_found, p5_neighbours, p6_found, p6_pieces, p7_packed, p7_variable, p8_found, p8_report, p9_found, p9_languages)}


_FORMS = """r AS (SELECT 'section' AS kind, id, section_text AS t FROM sections UNION ALL SELECT 'sentence', id, sentence_text FROM sentence_changes),
fo AS (SELECT DISTINCT kind, id, trim(regexp_replace(lower(t), '[^\\p{L}\\p{M}\\p{Nd}]+', ' ', 'g')) AS f FROM r WHERE t IS NOT NULL),
lo AS (SELECT kind, id, f FROM fo WHERE length(f) >= 40),
tk AS (SELECT DISTINCT kind, f, substring(f, i, 5) AS g FROM (SELECT kind, f, unnest(range(1, length(f) - 3)) AS i FROM (SELECT DISTINCT kind, f FROM lo))),
nt AS (SELECT kind, f, count(*) AS n FROM tk GROUP BY ALL),
nf AS (SELECT kind, f, row_number() OVER (ORDER BY kind, f) AS no, n FROM nt),
tn AS (SELECT kind, no, n, g FROM tk JOIN nf USING (kind, f)),
bo AS (SELECT a.no AS x, b.no AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM tn a JOIN tn b ON a.kind = b.kind AND a.g = b.g AND a.no < b.no AND a.n >= 0.69 * b.n AND b.n >= 0.69 * a.n GROUP BY ALL),
si AS (SELECT x, y FROM bo WHERE c::DOUBLE / (nx + ny - c) >= 0.7 UNION ALL SELECT no, no FROM nf),
wi AS (SELECT lo.kind, lo.id, nf.no FROM lo JOIN nf USING (kind, f)),
pa AS (SELECT DISTINCT a.kind AS record_kind, least(a.id, b.id) AS record_id_a, greatest(a.id, b.id) AS record_id_b FROM si JOIN wi a ON a.no = x JOIN wi b ON b.no = y WHERE a.id <> b.id)"""

#: 32-bit floats read from the hexadecimal digits of their bytes, and the ten most similar others of each usable vector.
_NEAR = """hx AS (SELECT DISTINCT id, hex(embedding) AS h FROM sections WHERE octet_length(embedding) = 1536),
ui AS (SELECT id, i, ('0x' || h[8 * i + 7 : 8 * i + 8] || h[8 * i + 5 : 8 * i + 6] || h[8 * i + 3 : 8 * i + 4] || h[8 * i + 1 : 8 * i + 2])::BIGINT AS u FROM hx, range(0, 384) t(i)),
fl AS (SELECT id, i, (u >> 23) & 255 AS e, CASE WHEN u >= 2147483648 THEN -1 ELSE 1 END * CASE WHEN ((u >> 23) & 255) = 0 THEN (u & 8388607) * pow(2.0, -149) ELSE (1 + (u & 8388607) / 8388608.0::DOUBLE) * pow(2.0, ((u >> 23) & 255) - 127) END AS x FROM ui),
ve AS (SELECT id, list(x ORDER BY i) AS v FROM fl GROUP BY id HAVING max(e) < 255 AND sum(x * x) > 0),
ne AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS similarity FROM ve a JOIN ve b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 7) DESC, b.id) <= 10)"""

SQL = {
    "p2_found": f"WITH {_FORMS} SELECT * FROM pa",
    "p5_found": f"WITH {_NEAR} SELECT DISTINCT least(id, other) AS section_id_a, greatest(id, other) AS section_id_b FROM ne",
    "p5_neighbours": f"WITH {_NEAR} SELECT id AS section_id, other AS neighbour_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY id ORDER BY round(similarity, 7) DESC, other)::INT AS rank FROM ne WHERE id % 20 = 0",
}


def oracle_sql() -> dict[str, str]:
    return SQL
