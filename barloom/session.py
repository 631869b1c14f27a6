"""Spark session defaults shared by the entry points, the bench and the tests."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every job relies on: UTC session time, AQE, Arrow transfer, state maps of streams."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster supplies its own master."""
    spark = (
        configure(SparkSession.builder.master(f"local[{cores}]").appName("barloom"))
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs: the one that ``spark.checkpoint.dir`` names, or the context's.

    A cluster must name one, as its machines share no other. A local session without one, such as a test, gets a private
    folder once.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("no shared folder: set spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="barloom-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df):
    """Write ``df`` to the shared checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
