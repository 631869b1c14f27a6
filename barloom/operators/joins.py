"""Joins along time and by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.ranking import global_rank
from barloom.session import cut_lineage


def time_slices(points: DataFrame, bars: DataFrame, keys: Sequence[str], order: str, value: str, slices: int | None = None) -> DataFrame:
    """Points and bars on one time line per key, cut into slices of about equal numbers of rows by range partitioning, so
    that a dense day is as many slices as it has rows for. Written once: a slice is what its number says in every pass."""
    second = F.col(order).cast("timestamp").cast("double")
    bar = F.struct(second.alias("t"), F.col(value).cast("double").alias("v"))
    line = bars.select(*keys, second.alias("_t"), bar.alias("_bar"), F.lit(1).alias("_kind"), F.lit(None).cast(points.schema[order].dataType).alias(order)).where("_t IS NOT NULL").unionByName(
        points.select(*keys, second.alias("_t"), F.lit(None).cast("struct<t: double, v: double>").alias("_bar"), F.lit(2).alias("_kind"), order)
    )
    by = [*keys, "_t", "_kind"]
    ranged = line.repartitionByRange(slices, *by) if slices else line.repartitionByRange(*by)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))


def nearest(points: DataFrame, bars: DataFrame, keys: Sequence[str], order: str, value: str, slices: int | None = None) -> DataFrame:
    """The bar nearest in time to each point, ties to the earlier one; of bars of one time that with the greatest value.

    The nearest bars outside a slice come from a table with one row per key and slice, so a busy key, or a busy day of
    one, is spread over its slices. NULL is a key like others; bars without a time take no part, points without one and
    keys without bars get none.
    """
    keys = list(keys)
    line = time_slices(points, bars, keys, order, value, slices)
    earliest = F.when(F.col("_bar").isNotNull(), F.struct(-F.col("_t"), F.col("_bar.v")))
    edges = line.groupBy(*keys, "_slice").agg(F.max_by("_bar", earliest).alias("_first"), F.max("_bar").alias("_last"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    own = [f"_e{i}" for i in range(len(keys) + 1)]
    edges = edges.select(
        *(F.col(k).alias(e) for k, e in zip([*keys, "_slice"], own, strict=True)),
        F.last("_last", ignorenulls=True).over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(by_slice.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    ).where("_before IS NOT NULL OR _after IS NOT NULL")
    forward = Window.partitionBy(*keys, "_slice").orderBy("_t", "_kind", "_bar.v").rowsBetween(Window.unboundedPreceding, 0)
    # The same window in reverse order, so both directions are running aggregates.
    backward = Window.partitionBy(*keys, "_slice").orderBy(F.col("_t").desc(), F.col("_kind").desc(), "_bar.v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        line.withColumn("_l", F.last("_bar", ignorenulls=True).over(forward))
        .withColumn("_r", F.last("_bar", ignorenulls=True).over(backward))
        .filter(F.col("_kind") == 2)
        .join(edges, [F.col(k).eqNullSafe(F.col(e)) for k, e in zip([*keys, "_slice"], own, strict=True)], "left")
    )
    left, right = F.coalesce("_l", "_before"), F.coalesce("_r", "_after")
    best = F.when(F.col("_t").isNull(), None).when(left.isNull(), right).when(right.isNull(), left).when(F.col("_t") - left["t"] <= right["t"] - F.col("_t"), left).otherwise(right)
    return found.select(*keys, order, best.alias("_b")).select(*keys, order, F.col("_b.t").cast("long").alias("nearest_time"), F.col("_b.v").alias(value))


def ranked_search(assets: DataFrame, query: str, symbol: str, name: str) -> DataFrame:
    """Assets matching a text: exact symbol, then prefix, then contained in symbol or name; short symbols first."""
    needle = query.strip().lower()
    code, label = F.lower(F.col(symbol)), F.lower(F.coalesce(F.col(name), F.lit("")))
    rank = F.when(code == needle, 0).when(code.startswith(needle), 1).when(code.contains(needle) | label.contains(needle), 2)
    return assets.withColumn("rank", rank).filter(F.col("rank").isNotNull()).orderBy("rank", F.length(symbol), symbol)


def unique_labels(df: DataFrame, label: str, order: str, name: str = "unique_label") -> DataFrame:
    """``x, x-2, x-3`` for repeated labels; a made-up label that exists as a literal moves on to a free number.

    Repeats are numbered by one distributed sort, so that a label which most rows share is no single task. Literals of a
    stem are numbered likewise and reduced to runs of taken numbers; repeats and runs meet on one line per label, cut
    into slices by rows, each with what the slices before it had taken.
    """
    numbered = _numbered(df, label, [F.col(label), F.col(order)], "_k")
    literal = F.regexp_extract(label, TAKEN, 2).try_cast("long")
    taken = df.select(F.regexp_extract(label, TAKEN, 1).alias(label), literal.alias("_no")).where("_no >= 2").distinct()
    # Before the i-th taken number u lie u - i free ones, as many for all numbers of a run: what comes after them moves on by i.
    runs = _numbered(taken, label, [F.col(label), F.col("_no")], "_i").groupBy(label, (F.col("_no") - F.col("_i") + 1).alias("_at")).agg(F.max("_i").alias("_i"))
    line = numbered.withColumn("_at", F.col("_k")).unionByName(runs, allowMissingColumns=True).withColumn("_copy", F.col("_i").isNull())
    line = cut_lineage(line.repartitionByRange(label, "_at", "_copy").withColumn("_slice", F.spark_partition_id()))
    before = Window.partitionBy("_stem").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = line.groupBy(F.col(label).alias("_stem"), F.col("_slice").alias("_part")).agg(F.max("_i").alias("_last")).withColumn("_before", F.max("_last").over(before))
    edges = edges.where("_before IS NOT NULL").drop("_last")
    upto = Window.partitionBy(label, "_slice").orderBy("_at", "_copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = line.withColumn("_own", F.max("_i").over(upto)).where("_copy").join(edges, (F.col(label) == F.col("_stem")) & (F.col("_slice") == F.col("_part")), "left")
    number = F.col("_k") + F.coalesce("_own", "_before", F.lit(0))
    labelled = placed.withColumn(name, F.when(F.col("_k") == 1, F.col(label)).otherwise(F.concat_ws("-", F.col(label), number.cast("string"))))
    return labelled.drop("_k", "_i", "_at", "_copy", "_slice", "_own", "_before", "_stem", "_part")


#: A label that ends in a number as this module writes it.
TAKEN = r"(?s)^(.*)-([1-9]\d*)\z"


def _numbered(df: DataFrame, label: str, order: Sequence[Column], name: str) -> DataFrame:
    """The place of each row, from 1, among the rows of its label."""
    placed = cut_lineage(global_rank(df, order, "_rank"))
    first = placed.groupBy(F.col(label).alias("_label")).agg(F.min("_rank").alias("_first"))
    return placed.join(first, F.col(label).eqNullSafe(F.col("_label"))).withColumn(name, F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first", "_label")
