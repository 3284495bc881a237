"""Queries on implausible measurements (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.spikes import found, implausible
from tidemark.sources.tables import filings, table


def _scores(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, base, "drift_scores", "id", "company_id", "filing_id", "section_type", "cosine_distance", "jaccard_distance"), filings(spark, base, "id", "filing_date")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return found(*_scores(spark, base)).select(F.col("id").alias("drift_score_id"), "field_name")


def p3_extremes(spark: SparkSession, base: str) -> DataFrame:
    """Values beyond the fitted cutoff of their source, at fixed risk."""
    judged = implausible(*_scores(spark, base), every=False)
    return judged.where("beyond_risk").select(F.col("id").alias("drift_score_id"), "field_name", F.round("residual", 6).alias("residual"), F.round("cutoff", 4).alias("cutoff"))


QUERIES = {f.__name__: f for f in (p3_found, p3_extremes)}

_SOURCES = """f AS (SELECT DISTINCT id, filing_date FROM filings),
r AS (SELECT d.id, d.company_id, lower(trim(d.section_type)) AS section, d.filing_id, f.filing_date, x.field_name, x.value, x.top
  FROM drift_scores d LEFT JOIN f ON f.id = d.filing_id,
  LATERAL (SELECT 'cosine_distance' AS field_name, d.cosine_distance AS value, 2.000001 AS top UNION ALL SELECT 'jaccard_distance', d.jaccard_distance, 1.000001) x),
s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY field_name, company_id, section, filing_id ORDER BY id) = 1),
ok AS (SELECT * FROM s WHERE value IS NOT NULL AND NOT isnan(value) AND value >= -0.000001 AND value <= top),
m AS (SELECT field_name, company_id, section, count(*) AS n, median(value) AS mid FROM ok GROUP BY ALL),
a AS (SELECT ok.field_name, ok.company_id, ok.section, any_value(n) AS n, any_value(mid) AS mid, 1.4826 * median(abs(value - mid)) AS spread FROM ok JOIN m USING (field_name, company_id, section) GROUP BY ALL),
q AS (SELECT *, row_number() OVER w AS i, CASE WHEN value = lag(value) OVER w AND NOT isnan(value) THEN 0 ELSE 1 END AS new FROM s WHERE value IS NOT NULL WINDOW w AS (PARTITION BY field_name, company_id, section ORDER BY filing_date, filing_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY field_name, company_id, section ORDER BY i) AS run FROM q),
k AS (SELECT field_name, company_id, section, filing_id, count(*) OVER (PARTITION BY field_name, company_id, section, run) AS len, value AS v FROM g),
st AS (SELECT DISTINCT field_name, company_id, section, filing_id FROM k WHERE len >= 5 AND v <> 0)"""

_LAW = """us AS (SELECT field_name, company_id, section, quarter(filing_date) AS season, median(value) AS usual FROM ok GROUP BY ALL HAVING count(*) >= 12),
j0 AS (SELECT r.*, n, mid, spread, CASE WHEN value IS NOT NULL AND NOT isnan(value) AND value >= -0.000001 AND value <= top THEN value - coalesce(usual, mid) END AS residual
  FROM r LEFT JOIN (SELECT * FROM a JOIN m USING (field_name, company_id, section, n)) x USING (field_name, company_id, section) LEFT JOIN us ON us.field_name = r.field_name AND us.company_id = r.company_id AND us.section = r.section AND us.season IS NOT DISTINCT FROM quarter(r.filing_date)),
j1 AS (SELECT *, residual IS NOT NULL AND (abs(residual) > 3 * spread OR abs(value - mid) > 3 * spread) AS peak FROM j0),
j2 AS (SELECT *, CASE WHEN peak AND spread > 0 THEN greatest(abs(residual) / spread - 3, 0.0) END AS excess FROM j1),
o AS (SELECT field_name, company_id, section, count(excess) AS k, avg(excess) AS m, var_samp(excess) AS v, count(residual) AS total FROM j2 GROUP BY ALL),
w AS (SELECT field_name, count(excess) AS k, avg(excess) AS m, var_samp(excess) AS v, count(residual) AS total FROM j2 GROUP BY ALL),
l0 AS (SELECT o.field_name, o.company_id, o.section, o.k < 10 OR o.v IS NULL OR o.v <= 0.000000001 AS few, o.k AS k1, o.m AS m1, o.v AS v1, o.total AS t1, w.k AS k2, w.m AS m2, w.v AS v2, w.total AS t2 FROM o JOIN w USING (field_name)),
l1 AS (SELECT field_name, company_id, section, CASE WHEN few THEN k2 ELSE k1 END AS k, CASE WHEN few THEN m2 ELSE m1 END AS m, CASE WHEN CASE WHEN few THEN v2 ELSE v1 END > 0.000000001 THEN CASE WHEN few THEN v2 ELSE v1 END END AS v, CASE WHEN few THEN t2 ELSE t1 END AS total FROM l0),
l2 AS (SELECT *, least(0.5::DOUBLE * (1 - m * m / v), 0.45::DOUBLE) AS shape, 0.5::DOUBLE * m * (1 + m * m / v) AS scale, 0.0001::DOUBLE * total / nullif(k, 0) AS rate FROM l1),
l3 AS (SELECT field_name, company_id, section, 3 + CASE WHEN abs(shape) < 0.000001 THEN -scale * ln(rate) ELSE scale / shape * (pow(rate, -shape) - 1) END AS cutoff FROM l2)"""

SQL = {
    "p3_found": f"""WITH {_SOURCES}
SELECT r.id AS drift_score_id, r.field_name FROM r LEFT JOIN a USING (field_name, company_id, section) LEFT JOIN st ON st.field_name = r.field_name AND st.company_id = r.company_id AND st.section = r.section AND st.filing_id = r.filing_id
WHERE r.value IS NOT NULL AND (isnan(r.value) OR r.value < -0.000001 OR r.value > r.top OR (n >= 12 AND abs(r.value - mid) > 7 * spread) OR st.filing_id IS NOT NULL)
""",
    "p3_extremes": f"""WITH {_SOURCES},
{_LAW}
SELECT j2.id AS drift_score_id, field_name, round(residual, 6) AS residual, round(cutoff, 4) AS cutoff FROM j2 JOIN l3 USING (field_name, company_id, section) WHERE peak AND abs(residual) > cutoff * spread""",
}
