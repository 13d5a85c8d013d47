"""Session settings for stand-alone runs; on a cluster the submitting side's settings win."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDER: str | None = None  # one temporary folder per local process


def local_session(cores: str = "8", app: str = "packwise") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("PACKWISE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # the JVM never compiles methods above 8000 bytes: let wide projections use split methods instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A folder all executors reach: the cluster's `spark.checkpoint.dir`; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    global _LOCAL_FOLDER
    if _LOCAL_FOLDER is None:
        _LOCAL_FOLDER = tempfile.mkdtemp(prefix="packwise-")
    return _LOCAL_FOLDER


def staged(df: DataFrame) -> DataFrame:
    """Write a result several later steps need into the shared folder and read it back.

    It is computed once, its lineage ends there, and it survives the loss of executors.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tune(spark: SparkSession) -> None:
    """Settings that may be changed on a running session.

    The JVM never compiles methods above 8000 bytes; with this limit Spark uses split methods for
    wide projections instead of one huge interpreted one. Arrow batches are bounded by bytes as well as by rows.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # batches of long texts for Python workers: a few of them are in memory at a time, on both sides
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
