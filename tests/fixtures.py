"""Seeded bars for tests: a 32-bit generator and a mild mean-reverting walk."""

from __future__ import annotations

import datetime as dt

import pandas as pd

MASK = 0xFFFFFFFF


def uniform(seed: int):
    state = seed & MASK

    def signed_product(a, b):
        return (a * b) & MASK

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & MASK
        t = signed_product(state ^ (state >> 15), 1 | state)
        t = ((t + signed_product(t ^ (t >> 7), 61 | t)) & MASK) ^ t
        return ((t ^ (t >> 14)) & MASK) / 4294967296

    return draw


def seeded_bars(n: int, seed: int = 42, symbol: str = "AAA", step: int = 60) -> pd.DataFrame:
    draw, previous, rows = uniform(seed), 100.0, []
    for i in range(n):
        u = [draw() for _ in range(5)]
        close = previous * (1 + (u[0] - 0.5) * 0.04 - 0.0005 * (previous / 100 - 1))
        open_ = previous * (1 + (u[1] - 0.5) * 0.01)
        high = max(open_, close) * (1 + u[2] * 0.01)
        low = min(open_, close) * (1 - u[3] * 0.01)
        ts = dt.datetime(2023, 11, 14, 22, 13, 20) + dt.timedelta(seconds=step * i)
        rows.append((symbol, "1m", ts, open_, high, low, close, 1000.0 + int(u[4] * 9000)))
        previous = close
    return pd.DataFrame(rows, columns=["symbol", "timeframe", "ts", "open", "high", "low", "close", "volume"])


SCHEMA = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"


def bars_frame(spark, *frames):
    rows = []
    for frame in frames:
        for row in frame.itertuples(index=False):
            rows.append(tuple(None if isinstance(x, float) and x != x else (x.to_pydatetime() if hasattr(x, "to_pydatetime") else x) for x in row))
    return spark.createDataFrame(rows, SCHEMA)
