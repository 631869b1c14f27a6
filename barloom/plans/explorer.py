"""Bar exploration: slices, filters and what followed the matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.event_study import event_study
from barloom.schema import KEYS, ORDER


def newest(df: DataFrame, limit: int, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """The newest ``limit`` rows of each key.

    Rank filters of this form are evaluated as a per-partition top-n before the shuffle, so a large key
    does not travel whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def bars_slice(df: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Bars inside an inclusive time window; ``limit`` keeps the newest of each series."""
    if start is not None:
        df = df.filter(F.col(ORDER) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(ORDER) <= F.lit(end).cast("timestamp"))
    return df if limit is None else newest(df, limit)


def filter_study(df: DataFrame, tree: Mapping | None, horizons: Sequence[int] = (1, 5, 10, 20, 50), onset_only: bool = False) -> DataFrame:
    """Filter -> matches -> forward-return statistics, as one plan."""
    return event_study(df, tree, horizons, onset_only)
