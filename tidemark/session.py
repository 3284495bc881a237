"""Session construction and the two ways a plan is cut: checkpoints and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidemark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings every operator expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    On a cluster the package is installed or sent with ``--py-files``; a path
    that a node lacks does no harm there.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    held = environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset and the master
    is local (tests) does the session get a temporary folder of its own. On a
    cluster a missing folder is an error: executors share no local one.
    """
    held = spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if held is None:
        spark.sparkContext.setCheckpointDir(named)
    return named or held


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one that the file system drops when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = held.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(held)
    fs.deleteOnExit(held)
    _written.append(path)
    return path


#: Folders that the queries of this driver have written so far.
_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Drop the intermediate tables written so far, once no result that reads them is needed any more; tells how many."""
    n = 0
    while _written:
        held = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True))
    return n


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
