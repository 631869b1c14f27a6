"""Add indicator columns to a bars table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from barloom.operators import registry
from barloom.operators.layout import Layout
from barloom.operators.series import Ref, Series
from barloom.schema import FIELDS


def references(s: Series, ident: str, params: Mapping[str, object] | None = None) -> dict[str, Ref]:
    """Output name -> reference for one indicator on a series builder."""
    definition = registry.get(ident)
    if definition is None:
        raise KeyError(f"unknown indicator {ident!r}")
    return dict(zip(definition.outputs, definition.build(s, **registry.resolve(definition, params))))


def field(s: Series, key: str) -> Ref | None:
    """A base column or a canonical series key; None when it is neither."""
    if key in FIELDS and key in s.df.columns:
        return s.column(key)
    parsed = registry.parse_key(key)
    if parsed is None:
        return None
    definition, params, output = parsed
    return dict(zip(definition.outputs, definition.build(s, **params)))[output]


def add_series(df: DataFrame, keys: Iterable[str], layout: Layout | None = None) -> DataFrame:
    """Add one column per canonical series key; the column is named by the key."""
    s = Series(df, layout)
    for key in dict.fromkeys(keys):
        if key in FIELDS:
            continue
        ref = field(s, key)
        if ref is None:
            raise KeyError(f"not a canonical series key: {key!r}")
        s.output(key, ref)
    return s.build()


def indicator(df: DataFrame, ident: str, layout: Layout | None = None, **params) -> DataFrame:
    """Add every output of one indicator, named by its series key."""
    s = Series(df, layout)
    for output, ref in references(s, ident, params).items():
        s.output(registry.series_key(ident, params, output), ref)
    return s.build()


def enrich(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """The standard thirteen columns: averages, RSI, MACD, ATR, bands and cumulative VWAP."""
    s = Series(df, layout)
    lines = references(s, "macd")
    bands = references(s, "bollinger")
    columns = {
        "sma_20": references(s, "sma", {"period": 20})["value"],
        "ema_20": references(s, "ema", {"period": 20})["value"],
        "rsi_14": references(s, "rsi")["value"],
        "ema_12": references(s, "ema", {"period": 12})["value"],
        "ema_26": references(s, "ema", {"period": 26})["value"],
        "macd": lines["macd"],
        "macd_signal": lines["signal"],
        "macd_hist": lines["hist"],
        "atr_14": references(s, "atr")["value"],
        "bb_middle": bands["middle"],
        "bb_upper": bands["upper"],
        "bb_lower": bands["lower"],
        "vwap": references(s, "vwap")["value"],
    }
    for name, ref in columns.items():
        s.output(name, ref)
    return s.build()


def catalogue(spark) -> DataFrame:
    """The default series as a table."""
    return spark.createDataFrame(registry.catalogue()).select("category", "id", "name", "output", "key", "pane")


__all__ = ["add_series", "catalogue", "enrich", "field", "indicator", "references"]
