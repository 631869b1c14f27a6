"""The one bars table every operator works on: many series keyed by (symbol, timeframe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("symbol", "timeframe")
ORDER = "ts"
PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume")


def finite(value: Column) -> Column:
    """NaN and infinities become NULL; everything else is unchanged."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def normalise(df: DataFrame) -> DataFrame:
    """Map non-finite OHLCV values to NULL once, so later operators only meet NULL."""
    return df.withColumns({name: finite(F.col(name).cast("double")) for name in FIELDS if name in df.columns})
