"""Recurrences along a series, evaluated inside Arrow batches.

A linear recurrence ``y[t] = a[t] * y[t-1] + b[t]`` composes: two neighbouring steps are again one
such step. ``prefix_compose`` uses that to evaluate a whole batch in log2(rows) vector operations.
Rows with a missing step are the identity, and a row that starts a unit forgets everything before it.

The functions here see only the rows of one Spark partition, sorted by unit and time, one Arrow batch
at a time; the only state kept between batches is the last composed step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def prefix_compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running composition of affine steps (doubling: log2(n) passes over the arrays)."""
    a, b = a.copy(), b.copy()
    shift = 1
    while shift < len(a):
        b[shift:] += a[shift:] * b[:-shift]
        a[shift:] = a[shift:] * a[:-shift]
        shift *= 2
    return a, b


def running_count(start: np.ndarray, seen: np.ndarray, before: int) -> np.ndarray:
    """Count of ``seen`` rows since the last start; ``before`` carries over from the previous batch."""
    total = np.cumsum(seen) + before
    at_start = np.where(start, total - seen, -1)
    base = np.maximum.accumulate(at_start)
    return total - np.where(base < 0, 0, base)


def affine_udf(kinds: Sequence[float | None]):
    """One Arrow pass over several recurrences.

    ``kinds[i]`` is the smoothing weight of an exponential average (one input column) or None for an
    explicit recurrence (two input columns, step and offset). Inputs: the start flag, then the columns
    of each recurrence. Output fields per recurrence: ``a``, ``b`` (the composed step since the start,
    so the value is ``a * state + b``), ``n`` (inputs seen since the start).
    """
    fields = []
    for i in range(len(kinds)):
        fields += [T.StructField(f"a{i}", T.DoubleType()), T.StructField(f"b{i}", T.DoubleType())]
        fields += [T.StructField(f"n{i}", T.LongType())]

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        state = [(1.0, 0.0, 0)] * len(kinds)
        for batch in batches:
            start = batch[0].to_numpy(dtype=bool)
            out, position = {}, 1
            for i, weight in enumerate(kinds):
                x = batch[position].to_numpy(dtype=float)
                if weight is None:
                    offset = batch[position + 1].to_numpy(dtype=float)
                    position += 2
                    seen = ~(np.isnan(x) | np.isnan(offset))
                    a, b = np.where(seen, x, 1.0), np.where(seen, offset, 0.0)
                else:
                    position += 1
                    seen = ~np.isnan(x)
                    a, b = np.where(seen, 1.0 - weight, 1.0), np.where(seen, weight * np.nan_to_num(x), 0.0)
                a_prev, b_prev, n_prev = state[i]
                if not len(a):
                    out[f"a{i}"], out[f"b{i}"], out[f"n{i}"] = a, b, np.zeros(0, dtype="int64")
                    continue
                count = running_count(start, seen, n_prev)
                a_run, b_run = _compose_units(a, b, start, a_prev, b_prev)
                state[i] = (float(a_run[-1]), float(b_run[-1]), int(count[-1]))
                out[f"a{i}"], out[f"b{i}"], out[f"n{i}"] = a_run, b_run, count
            yield pd.DataFrame(out)

    return F.pandas_udf(run, T.StructType(fields)).asNondeterministic()


def recurrence_udf(kinds: Sequence[tuple[float, int] | None]):
    """Recurrences over whole keys, as values: one Arrow pass, one output field per recurrence.

    ``kinds[i]`` is (weight, warm-up) of an exponential average seeded by its first value, or None for
    an explicit recurrence of a step and an offset column.
    """
    schema = T.StructType([T.StructField(f"y{i}", T.DoubleType()) for i in range(len(kinds))])

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        state = [(0.0, 0)] * len(kinds)
        for batch in batches:
            start = batch[0].to_numpy(dtype=bool)
            out, position = {}, 1
            for i, kind in enumerate(kinds):
                x = batch[position].to_numpy(dtype=float)
                offset = x if kind else batch[position + 1].to_numpy(dtype=float)
                position += 1 if kind else 2
                seen = ~(np.isnan(x) | np.isnan(offset))
                if not len(x):
                    out[f"y{i}"] = x
                    continue
                value, before = state[i]
                count = running_count(start, seen, before)
                if kind:
                    weight, warmup = kind
                    a, b = np.where(seen, 1.0 - weight, 1.0), np.where(seen, weight * np.nan_to_num(x), 0.0)
                    first = seen & (count == 1)
                    a[first], b[first] = 0.0, x[first]
                    shown = seen & (count >= warmup)
                else:
                    a, b, shown = np.where(seen, x, 1.0), np.where(seen, offset, 0.0), seen
                a[start] = 0.0
                b[0] += a[0] * value
                y = prefix_compose(a, b)[1]
                state[i] = (float(y[-1]), int(count[-1]))
                out[f"y{i}"] = np.where(shown, y, np.nan)
            yield pd.DataFrame(out)

    return F.pandas_udf(run, schema).asNondeterministic()


def _compose_units(a, b, start, a_prev, b_prev):
    """Composition within units. A start row must not compose with the rows before it.

    The linear factor is kept apart: zeroing it at a start cuts the offsets, while the true factor of
    the unit is rebuilt from a product that restarts there.
    """
    cut = a.copy()
    cut[start] = 0.0
    if not start[0]:
        b = b.copy()
        b[0] += a[0] * b_prev
    _, b_run = prefix_compose(cut, b)
    # Product of factors since the unit started, by the same doubling with resets.
    flag = start.copy()
    a_run = a.copy()
    if not start[0]:
        a_run[0] *= a_prev
    shift = 1
    while shift < len(a_run):
        joined = ~flag[shift:]
        a_run[shift:] = np.where(joined, a_run[shift:] * a_run[:-shift], a_run[shift:])
        flag[shift:] = flag[shift:] | flag[:-shift]
        shift *= 2
    return a_run, b_run


def stateful_udf(kernel: Callable, inputs: int, outputs: Sequence[str], state_size: int):
    """A non-linear recurrence, one row at a time within a partition.

    ``kernel(state, values) -> (state, outputs)`` where ``state`` is a tuple of floats or None. Inputs:
    the start flag, ``state_size`` entry-state columns (all NULL for a cold start; read on start rows
    only) and the value columns. Output: the value fields, then the state after the row.
    """
    names = [*outputs, *(f"state{i}" for i in range(state_size))]
    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in names])

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            columns = [series.to_numpy(dtype=float) for series in batch[1:]]
            start = batch[0].to_numpy(dtype=bool)
            rows = list(zip(*(column.tolist() for column in columns)))
            result = []
            for is_start, row in zip(start.tolist(), rows):
                if is_start:
                    entry = row[:state_size]
                    state = None if any(x != x for x in entry[:1]) else entry
                state, values = kernel(state, row[state_size:])
                kept = state if state is not None else (float("nan"),) * state_size
                result.append((*values, *kept))
            yield pd.DataFrame(result, columns=names, dtype=float)

    return F.pandas_udf(run, schema).asNondeterministic()
