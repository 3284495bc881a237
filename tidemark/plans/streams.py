"""Streaming queries, drained, with batch SQL as their oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.views import tok_sql
from tidemark.streaming import events as E


def stream_tumbling(spark: SparkSession, base: str) -> DataFrame:
    return E.drained(E.tumbling(E.stream(spark, base, "events")), "complete")


def stream_sliding(spark: SparkSession, base: str) -> DataFrame:
    return E.drained(E.sliding(E.stream(spark, base, "events")), "complete")


def stream_session(spark: SparkSession, base: str) -> DataFrame:
    return E.drained(E.sessions(E.stream(spark, base, "events")), "complete")


def stream_dedup(spark: SparkSession, base: str) -> DataFrame:
    return E.drained(E.new_only(E.stream(spark, base, "filings")), "append")


def stream_df_counts(spark: SparkSession, base: str) -> DataFrame:
    return E.drained(E.ngram_frequency(E.stream(spark, base, "documents")), "complete").where("df >= 5")


def stream_prev_value(spark: SparkSession, base: str) -> DataFrame:
    return E.drained(E.stateful(E.stream(spark, base, "events"), "previous"), "append")


def stream_running_z(spark: SparkSession, base: str) -> DataFrame:
    return E.drained(E.stateful(E.stream(spark, base, "events"), "z"), "append").withColumn("z", F.round("z", 4))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_dedup, stream_df_counts, stream_prev_value, stream_running_z)}

SQL = {
    "stream_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS raw, ts FROM events) e, LATERAL (SELECT raw AS start) WHERE ts < start + INTERVAL 2 DAYS GROUP BY start",
    "stream_session": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, no",
    "stream_dedup": "SELECT DISTINCT replace(accession_number, '-', '') AS accession FROM filings",
    "stream_df_counts": f"WITH w AS (SELECT doc_id, {tok_sql('text')} AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS phrase FROM w) SELECT phrase, count(*) AS df FROM n GROUP BY phrase HAVING count(*) >= 5",
    "stream_prev_value": "SELECT event_id, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events WHERE value IS NOT NULL",
    "stream_running_z": "WITH b AS (SELECT event_id, user_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, user_id, round(CASE WHEN n >= 3 AND s >= 0.001 THEN (value - m) / s END, 4) AS z FROM b",
}
