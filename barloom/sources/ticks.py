"""Bars from ticks or from daily records, as one keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.schema import ORDER


def bars_from_ticks(
    ticks: DataFrame,
    symbol: Column,
    bucket: Column,
    price: Column,
    order: Column,
    timeframe: str,
) -> DataFrame:
    """One bar per (symbol, bucket): first, highest, lowest and last price and the tick count.

    ``order`` decides first and last inside a bucket. Ticks without a positive price make no bar. The
    aggregates combine on the map side, so one busy symbol does not travel tick by tick.
    """
    named = ticks.select(symbol.alias("symbol"), bucket.alias(ORDER), price.cast("double").alias("p"), order.alias("o"))
    return (
        named.filter(F.col("p") > 0)
        .groupBy("symbol", ORDER)
        .agg(
            F.min_by("p", "o").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "o").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), ORDER, "open", "high", "low", "close", "volume")
    )


def event_bars(events: DataFrame) -> DataFrame:
    """Hourly bars of an event stream, one series per event type."""
    ts = F.col("ts").cast("timestamp")
    return bars_from_ticks(
        events, F.col("event_type"), F.date_trunc("hour", ts), F.col("value"), F.struct("ts", "event_id"), "1h"
    )


def order_bars(orders: DataFrame) -> DataFrame:
    """Daily bars of order totals, one series per order priority."""
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    return bars_from_ticks(orders, F.col("o_orderpriority"), day, F.col("o_totalprice"), F.col("o_orderkey"), "1d")


