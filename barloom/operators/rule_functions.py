"""Rules written as plain functions: a frame of bars in, a target of 0 or 1 for every bar out.

A function with a ``lookback`` sees slices of a series with that many earlier bars, so a long series is many groups of a
bounded size; one without sees whole series, of ``MOST_BARS`` at most. The look-ahead probe calls the function again on
shortened frames in the same pass, without a plan or a join for each cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.backtest import Rule
from barloom.operators.downsample import numbered
from barloom.operators.layout import Layout
from barloom.operators.series import Ref, Series
from barloom.operators.verdict import PROBE_FRACTIONS

SLICE_BARS, MOST_BARS = 200_000, 5_000_000
LEAST_BARS = 2


class RuleContractError(ValueError):
    """A rule function gave something else than a 0 or 1 for every bar."""


class LookaheadError(ValueError):
    """A rule's targets change when later bars are removed."""


@dataclass(frozen=True)
class RuleFunction:
    """``call`` gets bars in order and may only use a bar's own and ``lookback`` earlier ones (None: all earlier ones)."""

    id: str
    call: Callable[[pd.DataFrame], object]
    lookback: int | None = None


def checked(rule: RuleFunction, bars: pd.DataFrame) -> np.ndarray:
    """The rule's targets for a frame; the function gets a copy, so that it can't change what others see."""
    try:
        values = np.asarray(rule.call(bars.copy()), dtype=float)
    except (TypeError, ValueError) as error:
        raise RuleContractError(f"rule {rule.id}: targets aren't numbers: {error}") from error
    if values.shape != (len(bars),):
        raise RuleContractError(f"rule {rule.id}: {len(bars)} bars, but targets of shape {values.shape}")
    if not np.isin(values, (0.0, 1.0)).all():
        raise RuleContractError(f"rule {rule.id}: every target must be 0 or 1")
    return values


def _groups(df: DataFrame, rules: Sequence[RuleFunction], layout: Layout, slice_bars: int) -> tuple[DataFrame, list[str]]:
    """Bars with ``_i, _n, _slice, _own``, a bar once for each slice that looks back on it, and what groups them."""
    if len({r.id for r in rules}) != len(rules):
        raise ValueError("rule ids must differ")
    rows, keys = numbered(df, layout)
    if any(r.lookback is None for r in rules):
        return rows.withColumn("_slice", F.lit(0).cast("long")).withColumn("_own", F.lit(True)), keys
    own, reach = F.floor(F.col("_i") / slice_bars), max(r.lookback for r in rules)
    last = F.least(F.floor((F.col("_i") + reach) / slice_bars), F.floor((F.col("_n") - 1) / slice_bars))
    sliced = rows.withColumn("_slice", F.explode(F.sequence(own, last)))
    return sliced.withColumn("_own", F.floor(F.col("_i") / slice_bars) == F.col("_slice")), [*keys, "_slice"]


def _bars(frame: pd.DataFrame, order: str) -> pd.DataFrame:
    if len(frame) > MOST_BARS:
        raise RuleContractError(f"{len(frame)} bars in one group: give the rule a lookback")
    return frame.sort_values([order, "_i"], kind="stable").reset_index(drop=True)


def function_targets(df: DataFrame, rules: Sequence[RuleFunction], layout: Layout | None = None, slice_bars: int = SLICE_BARS) -> DataFrame:
    """Every bar with one column ``_f0, _f1, ...`` for each rule's target. An error names a rule that breaks the contract."""
    layout = layout or Layout()
    grouped, by = _groups(df, rules, layout, slice_bars)
    columns, order = df.columns, layout.order

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _bars(frame, order)
        own = frame["_own"].to_numpy(bool)
        out = frame.loc[own, columns].copy()
        for k, rule in enumerate(rules):
            out[f"_f{k}"] = checked(rule, frame[columns])[own]
        return out

    schema = T.StructType([*df.schema.fields, *(T.StructField(f"_f{k}", T.DoubleType()) for k in range(len(rules)))])
    return grouped.groupBy(*by).applyInPandas(run, schema)


def with_functions(df: DataFrame, rules: Sequence[RuleFunction], layout: Layout | None = None, slice_bars: int = SLICE_BARS) -> tuple[DataFrame, list[Rule], Callable[[Series, Rule], Ref]]:
    """Bars, rules and a ``target_of`` for ``fills`` and ``verdict``, with functions in the place of grid rules."""
    place = {r.id: f"_f{k}" for k, r in enumerate(rules)}
    named = [Rule(r.id, "function", r.id, ()) for r in rules]
    return function_targets(df, rules, layout, slice_bars), named, lambda s, rule: s.column(place[rule.id])


def probe_functions(df: DataFrame, rules: Sequence[RuleFunction], layout: Layout | None = None, slice_bars: int = SLICE_BARS) -> DataFrame:
    """``keys, order, rule, cut``: bars whose target changes when only the first ``cut`` share of the series is there. Honest
    rules yield no rows. Only the slice that a cut falls into is judged again."""
    layout = layout or Layout()
    grouped, by = _groups(df, rules, layout, slice_bars)
    columns, order, keys = df.columns, layout.order, list(layout.keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _bars(frame, order)
        index, own, found = frame["_i"].to_numpy(), frame["_own"].to_numpy(bool), []
        for rule in rules:
            whole = None
            for share in PROBE_FRACTIONS:
                cut = max(LEAST_BARS, math.floor(int(frame["_n"].iloc[0]) * share))
                left = int(np.searchsorted(index, cut))
                if not 0 < left < len(frame):
                    continue
                whole = checked(rule, frame[columns]) if whole is None else whole
                part = checked(rule, frame[columns].iloc[:left])
                differs = frame.iloc[:left][(part != whole[:left]) & own[:left]]
                found.append(differs[[*keys, order]].assign(rule=rule.id, cut=share))
        return pd.concat(found) if found else frame.iloc[:0][[*keys, order]].assign(rule="", cut=0.0)

    schema = T.StructType([*(df.schema[c] for c in (*keys, order)), T.StructField("rule", T.StringType()), T.StructField("cut", T.DoubleType())])
    return grouped.groupBy(*by).applyInPandas(run, schema)


def require_honest(df: DataFrame, rules: Sequence[RuleFunction], layout: Layout | None = None) -> None:
    """Raises ``LookaheadError`` with the first rules found to look ahead."""
    cheats = [r.rule for r in probe_functions(df, rules, layout).select("rule").distinct().orderBy("rule").limit(20).collect()]
    if cheats:
        raise LookaheadError(f"look-ahead integrity check failed: {', '.join(cheats)}")
