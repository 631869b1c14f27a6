"""Reduce long series to a bounded number of rows for display.

All of these place rows by index within the series (or by time), then aggregate per bucket, so the
large table is only numbered and pre-aggregated, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.layout import Layout
from barloom.operators.series import Ref, Series

MAX_POINTS = 1500


def numbered(df: DataFrame, layout: Layout | None = None) -> tuple[DataFrame, list[str]]:
    """Bars with their 0-based index ``_i`` and the series length ``_n``."""
    s = Series(df, layout)
    anchor: Ref = s.row("one", lambda c: F.lit(1.0), s.column(s.layout.order))
    s.output("_i", s.row("idx", lambda c: c.cast("long") - 1, s.running("count", anchor)))
    keys = list(s.layout.keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return s.build().join(sizes, keys), keys


def _bucket_of(i: Column, n: Column, points: int) -> Column:
    """Bucket whose bounds are ``floor(linspace(0, n, points - 1))``."""
    width = n / F.lit(points - 2)
    guess = F.floor(i / width)
    bound = lambda k: F.floor(k * width)
    return F.when(i < bound(guess), guess - 1).when(i >= bound(guess + 1), guess + 1).otherwise(guess).cast("int")


def decimate(df: DataFrame, value: str, keep_minimum: bool, points: int = MAX_POINTS, layout: Layout | None = None) -> DataFrame:
    """At most ``points`` rows per series: each bucket's minimum (or last row), the first and the last."""
    rows, keys = numbered(df, layout)
    order = (layout or Layout()).order
    rows = rows.withColumn("_b", F.when(F.col("_n") > points, _bucket_of(F.col("_i"), F.col("_n"), points)).otherwise(F.col("_i")))
    row = F.struct(order, value, "_i")
    pick = F.min_by(row, F.struct(F.col(value), F.col("_i"))) if keep_minimum else F.max_by(row, "_i")
    picked = rows.groupBy(*keys, "_b").agg(pick.alias("r")).select(*keys, "r.*")
    ends = rows.groupBy(*keys).agg(F.array(F.min_by(row, "_i"), F.max_by(row, "_i")).alias("e")).select(*keys, F.explode("e").alias("r")).select(*keys, "r.*")
    return picked.unionByName(ends).dropDuplicates([*keys, "_i"]).drop("_i")


def every_nth(df: DataFrame, value: str, limit: int = 240, layout: Layout | None = None) -> DataFrame:
    """Every ``ceil(n / limit)``-th row and the last, values rounded to 8 decimals."""
    rows, keys = numbered(df, layout)
    order = (layout or Layout()).order
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / limit))
    kept = rows.filter((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1))
    return kept.select(*keys, order, F.round(value, 8).alias(value))


def bucket_candles(df: DataFrame, width: int, start: int = 0, end: int | None = None, flag: str | None = None, layout: Layout | None = None) -> DataFrame:
    """One candle per pixel column over the index range [start, end); bars with a missing price are skipped."""
    rows, keys = numbered(df, layout)
    stop = F.col("_n") if end is None else F.lit(end)
    span = stop - F.lit(start)
    rows = rows.filter((F.col("_i") >= start) & (F.col("_i") < stop) & (span > 0))
    for name in ("open", "high", "low", "close"):
        rows = rows.filter(F.col(name).isNotNull())
    dense = span / F.lit(max(1, width)) > 1
    x = F.when(dense, F.floor((F.col("_i") - start) / span * width)).otherwise(F.col("_i")).cast("long")
    hit = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    return rows.groupBy(*keys, x.alias("x")).agg(
        F.min_by("open", "_i").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_i").alias("close"),
        F.min("_i").alias("from"), F.max("_i").alias("to"), F.bool_or(hit).alias("flagged"),
    )


def _gap_runs(rows: DataFrame, value: str, unit: list[str]) -> DataFrame:
    """Number the stretches between missing values inside each pixel column."""
    w = Window.partitionBy(*unit).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_gap", F.coalesce(F.count_if(F.col(value).isNull()).over(w), F.lit(0)))


def decimate_minmax(df: DataFrame, value: str, width: int, layout: Layout | None = None) -> DataFrame:
    """Minimum and maximum of each pixel column, missing values kept where they are."""
    rows, keys = numbered(df, layout)
    order = (layout or Layout()).order
    sparse = F.col("_n") <= width * 2
    rows = rows.withColumn("_x", F.when(sparse, F.col("_i")).otherwise(F.floor(F.col("_i") / F.col("_n") * width)).cast("long"))
    rows = _gap_runs(rows, value, [*keys, "_x"])
    point = F.struct(F.col("_i").alias("i"), order, F.col(value).alias(value))
    ends = rows.filter(F.col(value).isNotNull()).groupBy(*keys, "_x", "_gap").agg(
        F.array_distinct(F.array(F.min_by(point, F.struct(F.col(value), F.col("_i"))), F.min_by(point, F.struct(-F.col(value), F.col("_i"))))).alias("p")
    )
    found = ends.select(*keys, F.explode("p").alias("p")).select(*keys, "p.*")
    gaps = rows.filter(F.col(value).isNull()).select(*keys, F.col("_i").alias("i"), order, value)
    return found.unionByName(gaps)


def decimate_m4(df: DataFrame, value: str, width: int, layout: Layout | None = None) -> DataFrame:
    """First, minimum, maximum and last of each time column; one point for each run of missing values."""
    layout = layout or Layout()
    s = Series(df, layout)
    present = s.row("present", lambda v: F.when(v.isNotNull(), 1.0), s.column(value))
    s.output("_run", s.row("orzero", lambda c: F.coalesce(c, F.lit(0)), s.running("count", s.row("missing", lambda v: F.when(v.isNull(), 1.0), s.column(value)))))
    s.output("_prev_gap", s.row("pg", lambda p, q: p.isNull() & q.isNotNull(), s.lag(present), s.lag(s.row("one", lambda t: F.lit(1.0), s.column(layout.order)))))
    rows, keys = numbered(s.build(), layout)
    order = layout.order
    clock = F.col(order).cast("timestamp").cast("double")
    times = df.groupBy(*keys).agg(F.min(order).cast("timestamp").cast("double").alias("_t0"), F.max(order).cast("timestamp").cast("double").alias("_t1"))
    span = F.col("_t1") - F.col("_t0")
    column = F.when(F.col("_n") <= width * 2, F.col("_i")).when(span > 0, F.floor((clock - F.col("_t0")) / span * width)).otherwise(F.floor(F.col("_i") / F.col("_n") * width))
    rows = rows.join(times, keys).withColumn("_x", column.cast("long"))
    point = F.struct(F.col("_i").alias("i"), order, F.col(value).alias(value))
    picks = rows.filter(F.col(value).isNotNull()).groupBy(*keys, "_x", "_run").agg(
        F.array_distinct(F.array(
            F.min_by(point, "_i"), F.min_by(point, F.struct(F.col(value), F.col("_i"))),
            F.min_by(point, F.struct(-F.col(value), F.col("_i"))), F.max_by(point, "_i"),
        )).alias("p")
    )
    found = picks.select(*keys, F.explode("p").alias("p")).select(*keys, "p.*")
    gaps = rows.filter(F.col(value).isNull() & ~F.col("_prev_gap")).select(*keys, F.col("_i").alias("i"), order, value)
    return found.unionByName(gaps)


#: Readers' order of text: letters before their case and accents.
TEXT_ORDER = "UNICODE"


def sort_key(df: DataFrame, column: str, descending: bool = False, collation: str | None = TEXT_ORDER) -> Column:
    """Order of one column with missing values last in both directions; text goes by ``collation``, or by bytes without one."""
    key = F.col(column)
    if collation and isinstance(df.schema[column].dataType, T.StringType):
        key = F.collate(key, collation)
    return key.desc_nulls_last() if descending else key.asc_nulls_last()


def sort_rows(df: DataFrame, column: str, descending: bool = False, row_id: str | None = None, collation: str | None = TEXT_ORDER) -> DataFrame:
    """Sort by ``sort_key``; ``row_id`` makes ties stable."""
    key = sort_key(df, column, descending, collation)
    return df.orderBy(key, F.col(row_id)) if row_id else df.orderBy(key)


def top_by(df: DataFrame, column: str, n: int, tie: str, group: list[str] | None = None) -> DataFrame:
    """The ``n`` largest rows (missing values last), overall or in each group."""
    if not group:
        return df.orderBy(F.col(column).desc_nulls_last(), F.col(tie)).limit(n)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(column).desc_nulls_last(), F.col(tie)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
