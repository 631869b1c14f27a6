"""Sentiment index readings: comparisons, zones and range statistics.

A reading table has ``time`` (UTC seconds) and ``score`` (0-100); ``keys`` separate several indexes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import BANDS, band_for, months_back

DAY = 86_400


def _day(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def last_days(readings: DataFrame, days: int | None, keys: Sequence[str] = ()) -> DataFrame:
    """Readings of the trailing window that ends at the last reading of each index."""
    if days is None:
        return readings
    last = readings.groupBy(*keys).agg(F.max("time").alias("_last"))
    joined = readings.join(last, list(keys)) if keys else readings.join(F.broadcast(last))
    return joined.filter(F.col("time") >= F.col("_last") - days * DAY).drop("_last")


def snapshots(readings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Yesterday, a week and a month before the last reading's day, and the extremes of its year.

    A day without a reading stays missing. The last reading of a day stands for it; the latest of equal
    extremes wins. Everything but the day lookup is one aggregation.
    """
    keys = list(keys)
    last = readings.groupBy(*keys).agg(F.max("time").alias("_last"))
    days = readings.withColumn("day", _day(F.col("time"))).groupBy(*keys, "day").agg(F.max_by(F.struct("score", "time"), "time").alias("r"))
    wanted = F.array(*(
        F.struct(F.lit(name).alias("snapshot"), day.alias("day"))
        for name, day in (
            ("yesterday", F.date_sub(_day(F.col("_last")), 1)), ("week_ago", F.date_sub(_day(F.col("_last")), 7)), ("month_ago", months_back(_day(F.col("_last")), 1)),
        )
    ))
    points = last.select(*keys, F.explode(wanted).alias("w")).select(*keys, "w.*").join(days, [*keys, "day"], "left").select(*keys, "snapshot", "r.score", "r.time")
    year = last_days(readings, 365, keys).groupBy(*keys).agg(
        F.max_by(F.struct("score", "time"), F.struct("score", "time")).alias("hi"), F.min_by(F.struct("score", "time"), F.struct("score", -F.col("time"))).alias("lo")
    )
    extremes = year.select(*keys, F.explode(F.array(F.struct(F.lit("year_high").alias("snapshot"), F.col("hi").alias("r")), F.struct(F.lit("year_low").alias("snapshot"), F.col("lo").alias("r")))).alias("w")).select(*keys, "w.snapshot", "w.r.score", "w.r.time")
    return points.unionByName(extremes).withColumn("band", band_for(F.col("score"))).withColumn("label", band_for(F.col("score"), "label"))


def zone_counts(readings: DataFrame, days: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Count and share of readings per band; every band appears."""
    keys = list(keys)
    counted = last_days(readings, days, keys).withColumn("band", band_for(F.col("score"))).filter(F.col("band").isNotNull()).groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    grid = total.select(*keys, "_total", F.explode(F.array(*(F.lit(b[0]) for b in BANDS))).alias("band"))
    return grid.join(counted, [*keys, "band"], "left").select(
        *keys, "band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.col("n"), F.col("_total")), F.lit(0.0)).alias("share")
    )


def range_summary(readings: DataFrame, days: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, extremes (the latest of equals) and net change over a trailing window."""
    x = F.struct("score", "time")
    return last_days(readings, days, keys).groupBy(*keys).agg(
        F.count("score").alias("count"), F.avg("score").alias("mean"), F.max_by(x, x).alias("h"), F.min_by(x, F.struct("score", -F.col("time"))).alias("l"),
        (F.max_by("score", "time") - F.min_by("score", "time")).alias("change"),
    ).select(*keys, "count", "mean", F.col("h.score").alias("high"), F.col("h.time").alias("high_time"), F.col("l.score").alias("low"), F.col("l.time").alias("low_time"), "change")
