"""Readers for the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import reachable


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """One table of ``base``; only ``columns`` are read where they are named."""
    reachable(spark)
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def filings(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """The filings, each once: rows that stand twice are entirely equal."""
    cols = columns or ("id", "company_id", "accession_number", "form_type", "filing_date", "report_date", "status", "created_at")
    first = [F.first(c).alias(c) for c in cols if c != "id"]
    return table(spark, base, "filings", *dict.fromkeys(("id", *cols))).groupBy("id").agg(*first).select(*cols)
