"""File sources and sinks: submissions, tickers, phrase lists, lexicons, documents; ingest and rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.relational import padded_cik, zipped_rows
from tidemark.operators.sentences import lexicon_table

_RECENT = "struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>"
_SUBMISSIONS = f"cik string, name string, filings struct<recent:{_RECENT}>"


def submissions(spark: SparkSession, path: str, forms: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Filings of submission files (one JSON object a file): parallel arrays become rows.

    (cik, name, accession, form, filing_date, report_date, document); ragged arrays give nulls.
    """
    raw = spark.read.schema(_SUBMISSIONS).json(path, multiLine=True)
    r = F.col("filings.recent")
    arrays = raw.select(padded_cik(F.col("cik")).alias("cik"), "name", r["accessionNumber"].alias("accession"), r["form"].alias("form"), r["filingDate"].alias("filing_date"), r["reportDate"].alias("report_date"), r["primaryDocument"].alias("document"))
    rows = zipped_rows(arrays, ["accession", "form", "filing_date", "report_date", "document"], forms, start, end)
    return rows.withColumn("report_date", F.try_to_date(F.nullif(F.col("report_date"), F.lit(""))))


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, name) of an object of objects; of one ticker the entry of the last position counts."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,struct<cik_str:string,ticker:string,title:string>>")).alias("k", "v"))
    rows = entries.select(F.upper("v.ticker").alias("ticker"), padded_cik(F.col("v.cik_str")).alias("cik"), F.col("v.title").alias("name"), F.col("k").cast("bigint").alias("no"))
    return rows.groupBy("ticker").agg(F.max_by(F.struct("cik", "name"), "no").alias("x")).select("ticker", "x.*")


def phrase_list(spark: SparkSession, path: str) -> DataFrame:
    """(phrase) of the ``phrases`` array of a JSON file, in lower case, each once."""
    return spark.read.schema("phrases array<string>").json(path, multiLine=True).select(F.explode("phrases").alias("p")).select(F.lower(F.trim("p")).alias("phrase")).distinct()


def lexicon(spark: SparkSession, path: str | None) -> DataFrame:
    """(word, category) of a lexicon CSV with a header; without a file the lexicon is empty."""
    if path is None:
        return spark.createDataFrame([], "word string, category string")
    return lexicon_table(spark.read.csv(path, header=True))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def unseen(incoming: DataFrame, stored: DataFrame | None, key: str = "accession") -> DataFrame:
    """Incoming rows whose key is not stored yet, each key once (the smallest row of equals)."""
    columns = [c for c in incoming.columns if c != key]
    once = incoming.groupBy(key).agg(F.min(F.struct(*columns)).alias("r")).select(key, "r.*").select(*incoming.columns)
    return once if stored is None else once.join(stored.select(key), key, "left_anti")


def ingest(incoming: DataFrame, path: str, key: str = "accession") -> int:
    """Append the unseen rows to a Parquet table and tell how many there were; a second call adds none."""
    spark = incoming.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    # only a path that is not there means that there is no table yet; any other fault is raised
    held = spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
    new = unseen(incoming, held, key).cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def rewrite(rows: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that ``rows`` touch and leave all others: delete-then-rewrite, idempotent."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
