"""Structured Streaming forms of the periodic and stateful behaviours.

Each query reads the table as a stream, drains what is there
(``availableNow``), and hands back the sink's final state, so that a batch
query can be its oracle. Checkpoints and sinks live in the shared folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import reachable, scratch

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of files."""
    reachable(spark)
    path = f"{base.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(base)


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all input at hand and return its sink: all rows appended, or the last complete result."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    place = scratch(spark, "stream")
    writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint")
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{place}/sink").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{place}/sink")).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/sink")


def timed(events: DataFrame) -> DataFrame:
    """Events with an instant and a watermark of a day."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    g = timed(events).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day") -> DataFrame:
    g = timed(events).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    g = timed(events).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n")


def new_only(filings: DataFrame) -> DataFrame:
    """Filings as they arrive, each accession once (the poller's form)."""
    rows = filings.select(F.regexp_replace("accession_number", "-", "").alias("accession"), F.col("created_at").cast("timestamp").alias("created_at"))
    return rows.withWatermark("created_at", "3650 days").dropDuplicatesWithinWatermark(["accession"]).select("accession")


def ngram_frequency(docs: DataFrame) -> DataFrame:
    """Document frequency of two-word phrases, kept up to date as documents arrive."""
    from tidemark.functions.text import ngrams, tokens

    words = docs.where("text is not null").select(tokens(F.col("text")).alias("w"))  # a column of its own, or each phrase would split the text again
    phrases = words.select(F.explode(F.array_distinct(ngrams(F.col("w"), 2))).alias("phrase"))
    return phrases.groupBy("phrase").agg(F.count("*").alias("df"))


def _processor(kind: str):
    from pyspark.sql.streaming import StatefulProcessor

    class Previous(StatefulProcessor):
        """The value before, for each key."""

        def init(self, handle) -> None:
            self.last = handle.getValueState("last", "value double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            all_ = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            before = self.last.get()[0] if self.last.exists() else None
            out = all_[["event_id", "user_id"]].copy()
            out["previous"] = [before, *all_["value"].tolist()[:-1]]
            self.last.update((float(all_["value"].iloc[-1]),))
            yield out

        def close(self) -> None:
            pass

    class Running(StatefulProcessor):
        """Count, mean and squared deviation so far, for each key, and the z-score of each new value against them."""

        def init(self, handle) -> None:
            self.state = handle.getValueState("state", "n long, mean double, m2 double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            all_ = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            n, mean, m2 = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
            z = []
            for x in all_["value"]:
                std = (m2 / n) ** 0.5 if n else 0.0
                z.append((x - mean) / std if n >= 3 and std >= 0.001 else None)
                n += 1
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
            self.state.update((int(n), float(mean), float(m2)))
            out = all_[["event_id", "user_id"]].copy()
            out["z"] = z
            yield out

        def close(self) -> None:
            pass

    return Previous() if kind == "previous" else Running()


def stateful(events: DataFrame, kind: str) -> DataFrame:
    """(event_id, user_id, previous or z) by a state for each user."""
    name = "previous" if kind == "previous" else "z"
    rows = events.where("value is not null").select("event_id", "user_id", "ts", "value")
    return rows.groupBy("user_id").transformWithStateInPandas(_processor(kind), f"event_id bigint, user_id bigint, {name} double", "append", "none")
