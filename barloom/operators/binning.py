"""Equal-width bins as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge(i: Column, low: Column, high: Column, bins: Column | int) -> Column:
    count = bins if isinstance(bins, Column) else F.lit(bins)
    return F.when(i >= count, high).otherwise(low + i * ((high - low) / count))


def bin_of(x: Column, low: Column, high: Column, bins: Column | int) -> Column:
    """Bin ``[edge[i], edge[i+1])`` holding ``x``, clamped to the first and last bin.

    The division can land one bin off at an edge, so the neighbouring edges decide.
    """
    count = bins if isinstance(bins, Column) else F.lit(bins)
    guess = F.greatest(F.lit(0), F.least(F.floor((x - low) / (high - low) * count), count - 1)).cast("int")
    down = (x < edge(guess, low, high, bins)) & (guess > 0)
    up = (x >= edge(guess + 1, low, high, bins)) & (guess < count - 1)
    return F.when(down, guess - 1).when(up, guess + 1).otherwise(guess).cast("int")


def price_bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """The price range of a series; a flat one is widened by 0.5% or 1, whichever is larger."""
    margin = F.greatest(F.abs(low) * 0.005, F.lit(1.0))
    return F.when(low == high, low - margin).otherwise(low), F.when(low == high, high + margin).otherwise(high)
