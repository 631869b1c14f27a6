"""Writers: enriched bars, reports, and the keep-latest bar store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.indicators import enrich
from barloom.schema import FIELDS, KEYS, ORDER
from barloom.session import cut_lineage

DAY = "trade_date"


def write_enriched(bars: DataFrame, path: str, form: str = "parquet") -> None:
    """Bars with the thirteen standard columns, partitioned by series."""
    enrich(bars).write.mode("overwrite").partitionBy(*KEYS).option("header", True).format(form).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON; Spark's commit protocol publishes it only when complete."""
    report.write.mode("overwrite").json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def upsert_bars(updates: DataFrame, path: str, version: str = "version") -> None:
    """Merge updates into the store: the latest version of a bar wins, however late it comes.

    The store is partitioned by series and day. Only the days the updates touch are read and rewritten;
    identical rows change nothing. ``version`` orders the updates of one batch.
    """
    spark = updates.sparkSession
    stamp = F.to_date(ORDER)
    fresh = updates.select(*KEYS, ORDER, *FIELDS, F.col(version).cast("long").alias(version), stamp.alias(DAY))
    fresh = cut_lineage(fresh.groupBy(*KEYS, ORDER, DAY).agg(F.max_by(F.struct(*FIELDS, version), version).alias("b")).select(*KEYS, ORDER, DAY, "b.*"))
    if path_exists(spark, path):
        touched = fresh.select(*KEYS, DAY).distinct()
        stored = read_store(spark, path).join(touched, [*KEYS, DAY], "left_semi")
        # New rows beat stored ones whatever their number: batches arrive in order.
        both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
        merged = both.groupBy(*KEYS, ORDER, DAY).agg(F.max_by(F.struct(*FIELDS, version), F.struct("_new", version)).alias("b")).select(*KEYS, ORDER, DAY, "b.*")
        fresh = cut_lineage(merged)
    (
        fresh.repartition(*KEYS, DAY).sortWithinPartitions(*KEYS, ORDER)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS, DAY).parquet(path)
    )
