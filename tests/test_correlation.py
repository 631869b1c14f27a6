"""Correlation by tiles against pandas, at tiles and runs far smaller than the data."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from barloom.operators import aggregates
from barloom.operators.aggregates import correlation_matrix


def _frame(series, times, seed=5):
    draw = np.random.default_rng(seed)
    stamps = pd.date_range("2024-01-01", periods=times, freq="h")
    closes = 100 + draw.normal(size=(times, series)).cumsum(axis=0)
    rows = [(f"s{i:02d}", "1h", t, float(closes[k, i])) for i in range(series) for k, t in enumerate(stamps) if (i, k) != (2, 7)]
    return pd.DataFrame(rows, columns=["symbol", "timeframe", "ts", "close"])


@pytest.mark.parametrize(("tile", "rows"), [(3, 5), (128, 2048), (1, 1000)])
def test_tiles_agree_with_pandas(spark, tile, rows):
    frame = _frame(8, 40)
    wide = frame.pivot(index="ts", columns="symbol", values="close").dropna().pct_change().dropna()
    want = wide.corr()
    df = spark.createDataFrame(frame)
    got = correlation_matrix(df, df.select("symbol"), tile=tile, rows=rows).toPandas()
    assert len(got) == 64 and set(got["observations"]) == {len(wide)}
    for r in got.itertuples():
        assert r.corr == pytest.approx(want.loc[r.a, r.b], abs=1e-9)


def test_edges(spark):
    df = spark.createDataFrame(_frame(3, 3))
    assert correlation_matrix(df, ["s00", "s01"]).count() == 0
    assert correlation_matrix(df, ["s00", "absent"]).count() == 0
    flat = spark.createDataFrame([(s, "1h", dt.datetime(2024, 1, 1, k), c) for s, c in (("a", 1.0), ("b", 2.0)) for k in range(6)], "symbol string, timeframe string, ts timestamp, close double")
    assert {r["corr"] for r in correlation_matrix(flat, ["a", "b"]).collect()} == {None}


def test_single_pairs_are_not_shuffled(spark):
    """What exchanges move stays far below the pairs of labels."""
    frame = _frame(160, 12)
    frame.loc[frame["symbol"] == "s150", "close"] = 5.0
    wide = frame.pivot(index="ts", columns="symbol", values="close").dropna().pct_change().dropna()
    want = wide.corr()
    df = spark.createDataFrame(frame)
    found = correlation_matrix(df, df.select("symbol"), tile=40)
    got = found.toPandas()
    assert len(got) == 160 * 160 == len(set(zip(got["a"], got["b"])))
    for r in got.itertuples():
        flat = "s150" in (r.a, r.b)
        assert np.isnan(r.corr) if flat else r.corr == pytest.approx(want.loc[r.a, r.b], abs=1e-9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in top.replace("BroadcastExchange", "") and "SortMergeJoin" not in top


def test_blocks_of_many_series_go_to_few_tasks(spark):
    """With few timestamps each block goes to 25 tasks at most, however many series there are."""
    series = 30_000
    bars = spark.range(series * 4).selectExpr(
        f"concat('s', id % {series}) AS symbol", "'1h' AS timeframe", f"timestamp_seconds(3600 * (id div {series})) AS ts", "100 + hash(id) % 50 + 0.5D AS close"
    )
    plan = correlation_matrix(bars, bars.select("symbol"))._jdf.queryExecution().optimizedPlan().toString()
    last = re.search(r"explode\(sequence\(block#\d+, (\d+)", plan)
    assert int(last.group(1)) <= 24


@pytest.mark.parametrize("other", [0, 1])
def test_products_are_held_in_strips(other):
    """Two high blocks of one run are never multiplied as a whole; each strip gives its pairs in both directions, or once within a block."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(2_500, 4))
    x[7] = 0
    y = draw.normal(size=(3_000, 4)) if other else x
    sides = {"label": [f"a{i}" for i in range(len(x))], "square": (x * x).sum(axis=1), "x": x.ravel()}, {"label_b": [f"{'b' if other else 'a'}{i}" for i in range(len(y))], "square_b": (y * y).sum(axis=1), "y": y.ravel()}
    batch = pa.RecordBatch.from_pylist([{"block": 0, "other": other, **sides[0], **sides[1]}])
    strips = list(aggregates._correlated(iter([batch])))
    assert max(s.nbytes for s in strips) < len(x) * len(y) * 4
    got = {}
    for s in strips:
        for k in range(s.num_rows):
            row = {c: s.column(c)[k].values for c in ("a", "b", "corr")}
            assert len(row["a"]) * len(row["b"]) <= 1 << 16
            for i, a in enumerate(row["a"].to_pylist()):
                if a in ("a0", "a7", "a2499", "b11"):
                    pairs = [(a, b) for b in row["b"].to_pylist()]
                    assert not got.keys() & pairs
                    got |= zip(pairs, row["corr"][i].as_py(), strict=True)
    assert len(got) == (3 * 3_000 + 2_500 if other else 3 * 2_500)
    names = {n: v for n, v in zip(sides[0]["label"] + sides[1]["label_b"], [*x, *y])}
    for (a, b), v in got.items():
        if "a7" in (a, b):
            assert v is None
        else:
            assert v == pytest.approx(names[a] @ names[b] / np.sqrt((names[a] @ names[a]) * (names[b] @ names[b])), abs=1e-9)
