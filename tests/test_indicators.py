"""Seeded series: published values, brute force, no look-ahead, recovery after holes."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import registry
from barloom.operators.indicators import enrich, references
from barloom.operators.layout import Layout, plan_layout
from barloom.operators.series import Series
from tests.fixtures import bars_frame, seeded_bars

SIMPLE = ["sma", "rsi", "macd", "bollinger", "adx", "kama", "obv", "psar", "zscore", "cci", "klinger", "fisher"]


def values(spark, frame, idents):
    s = Series(bars_frame(spark, frame), Layout())
    for ident in idents:
        for name, ref in references(s, ident).items():
            s.output(f"{ident}_{name}", ref)
    return s.build().orderBy("ts").toPandas().iloc[:, 8:]


@pytest.fixture(scope="module")
def seeded():
    return seeded_bars(240)


def test_seeded_series_is_the_published_one(seeded):
    assert abs(seeded.close.sum() - 25648.5648141) < 1e-6
    assert abs(seeded.close.iloc[239] - 115.499652332) < 1e-8


def test_enrich_matches_published_values_and_pandas(spark, seeded):
    got = enrich(bars_frame(spark, seeded), Layout()).orderBy("ts").toPandas()
    # Published results on this series (index -> value).
    for column, known in {
        "sma_20": {19: 97.3643731108, 60: 94.6417974616, 239: 114.002661444},
        "ema_20": {19: 97.1417938007, 60: 93.9933113852, 239: 114.501412165},
        "ema_12": {19: 96.5038310253, 33: 94.6998936453},
    }.items():
        for i, value in known.items():
            assert got[column].iloc[i] == pytest.approx(value, rel=1e-9)
    close = seeded.close
    gain, loss = close.diff().clip(lower=0), -close.diff().clip(upper=0)
    smooth = [x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (gain, loss)]
    np.testing.assert_allclose(got.rsi_14, 100 - 100 / (1 + smooth[0] / smooth[1]), rtol=1e-9)
    line = close.ewm(span=12, adjust=False, min_periods=12).mean() - close.ewm(span=26, adjust=False, min_periods=26).mean()
    np.testing.assert_allclose(got.macd_signal, line.ewm(span=9, adjust=False, min_periods=9).mean(), rtol=1e-8)
    np.testing.assert_allclose(got.bb_upper, close.rolling(20).mean() + 2 * close.rolling(20).std(ddof=0), rtol=1e-9)


def test_values_do_not_depend_on_later_bars(spark, seeded):
    whole, part = values(spark, seeded, SIMPLE), values(spark, seeded.iloc[:150], SIMPLE)
    pd.testing.assert_frame_equal(whole.iloc[:150].reset_index(drop=True), part.reset_index(drop=True), rtol=1e-9)


def test_holes_recover(spark):
    frame = seeded_bars(500, 21)
    frame.loc[60, "close"] = np.nan
    frame.loc[180, "high"] = np.nan
    frame.loc[300, "volume"] = np.nan
    got = values(spark, frame, SIMPLE)
    assert got.iloc[-1].notna().all()
    assert got["sma_value"].iloc[60:80].isna().all() and got["sma_value"].iloc[80] == got["sma_value"].iloc[80]


def test_skewed_and_flat_inputs(spark):
    frame = seeded_bars(80)
    for c in ("open", "high", "low", "close"):
        frame[c] = 50.0
    frame["volume"] = 0.0
    got = values(spark, frame, ["rsi", "zscore", "clv", "cmo", "autocorrelation", "skew", "vwma", "bop", "linreg_r2"])
    last = got.iloc[-1]
    assert last["rsi_value"] == 50 and last["clv_value"] == 0 and last["cmo_value"] == 0 and last["bop_value"] == 0
    assert last[["zscore_value", "autocorrelation_value", "skew_value", "vwma_value", "linreg_r2_value"]].isna().all()


def test_series_keys():
    assert registry.series_key("macd", {"fast": "12"}, "hist") == "macd(fast=12,signal=9,slow=26).hist"
    assert registry.parse_key("rsi(period=14).value")[1] == {"period": 14}
    assert registry.parse_key("rsi(period=1000).value") is None and registry.parse_key("rsi(period=14).k") is None
    assert registry.resolve(registry.get("rsi"), {"period": 1e9}) == {"period": 500}


def test_long_windows_match_pandas(spark):
    frame = seeded_bars(1400, 5)
    frame.loc[700, "close"] = np.nan
    df = bars_frame(spark, frame)
    for layout in (Layout(), plan_layout(df, block_rows=500)):
        s = Series(df, layout)
        n = 300
        for name, ref in {"sum": s.sum(s.close, n), "mean": s.mean(s.close, n), "std": s.std(s.close, n, 1), "max": s.max(s.high, n), "min": s.min(s.low, n)}.items():
            s.output(name, ref)
        got = s.build().orderBy("ts").toPandas()
        roll = frame.close.rolling(n)
        for name, want in {"sum": roll.sum(), "mean": roll.mean(), "std": roll.std(), "max": frame.high.rolling(n).max(), "min": frame.low.rolling(n).min()}.items():
            np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(float), rtol=1e-8)
