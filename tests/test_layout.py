"""Cutting a long key into blocks must not change any value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import registry
from barloom.operators.event_study import event_study
from barloom.operators.filters import all_of, condition, flagged
from barloom.operators.indicators import references
from barloom.operators.layout import Layout, plan_layout, spread
from barloom.operators.series import Series
from tests.fixtures import bars_frame, seeded_bars

GROUPS = [
    ["sma", "wma", "linreg_r2", "aroon", "true_range", "max_drawdown", "percent_rank", "trima"],
    ["ema", "dema", "macd", "adx", "mass_index"],
    ["vwap", "obv", "nvi", "drawdown", "chaikin_osc", "klinger"],
    ["kama", "connors_rsi", "stoch_rsi"],
    ["mcginley", "fisher", "psar", "supertrend"],
]


@pytest.fixture(scope="module")
def frames(spark):
    long = seeded_bars(1500, 7, "HOT")
    long.loc[[60, 61, 900], "close"] = np.nan
    short = seeded_bars(90, 9, "COLD")
    df = bars_frame(spark, long, short)
    layout = plan_layout(df, block_rows=400)
    assert layout.cut and not plan_layout(df).cut
    return df, layout


def build(df, layout, idents):
    s = Series(df, layout)
    for ident in idents:
        for name, ref in references(s, ident).items():
            s.output(f"{ident}_{name}", ref)
    return s.build().orderBy("symbol", "ts").toPandas()


@pytest.mark.parametrize("idents", GROUPS, ids=lambda g: g[0])
def test_blocks_agree_with_whole_keys(frames, idents):
    df, layout = frames
    whole, cut = build(df, Layout(), idents), build(df, layout, idents)
    assert len(whole) == len(cut) == 1590
    for column in whole.columns[3:]:
        a, b = whole[column].to_numpy(dtype=float), cut[column].to_numpy(dtype=float)
        assert (np.isnan(a) == np.isnan(b)).all(), column
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), column


def test_spread_keeps_each_row_once_and_bounds_blocks(frames):
    df, layout = frames
    placed = spread(df, layout, 50)
    assert placed.filter("_own").count() == 1590
    sizes = placed.filter("_own").groupBy("symbol", "_block").count().toPandas()
    assert sizes["count"].max() <= 400 * 17 // 16 + 1
    assert len(sizes[sizes.symbol == "HOT"]) >= 4


def test_filters_and_studies_agree(frames):
    df, layout = frames
    tree = all_of(condition("rsi(period=14).value", "top_pct", 20), condition("close", "rising", 2))
    a = flagged(df, tree, Layout()).orderBy("symbol", "ts").toPandas()
    b = flagged(df, tree, layout).orderBy("symbol", "ts").toPandas()
    assert (a["matches"] == b["matches"]).all() and a["matches"].sum() > 20
    x = event_study(df, tree, (1, 10), layout=Layout()).orderBy("symbol", "horizon").toPandas()
    y = event_study(df, tree, (1, 10), layout=layout).orderBy("symbol", "horizon").toPandas()
    pd.testing.assert_frame_equal(x, y, rtol=1e-9)


def test_every_indicator_is_registered():
    assert len(registry.all_indicators()) == 127 and len(registry.catalogue()) == 158


def test_a_burst_is_cut_into_bounded_blocks(spark):
    years = bars_frame(spark, seeded_bars(1000, 3, "LONG")).withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") * 1000 - 1_698_300_000_000))
    short = bars_frame(spark, seeded_bars(20_000, 4, "BUSY")).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.floor((F.unix_seconds("ts") - 1_700_000_000) / 60)))
    burst = bars_frame(spark, seeded_bars(9000, 5, "BURST")).withColumn("_i", (F.unix_seconds("ts") - 1_700_000_000) / 60)
    burst = burst.withColumn("ts", F.timestamp_seconds(F.when(F.col("_i") < 8000, 1_700_000_000 + F.col("_i")).otherwise(1_700_000_000 + (F.col("_i") - 7999) * 1_000_000))).drop("_i")
    df = years.unionByName(short).unionByName(burst)
    layout = plan_layout(df, block_rows=2000)
    placed = spread(df, layout, 50).filter("_own")
    assert placed.count() == 30_000
    assert placed.groupBy("symbol", "_block").count().agg(F.max("count")).first()[0] <= 4000
    a, b = build(df, Layout(), ["sma", "ema", "drawdown"]), build(df, layout, ["sma", "ema", "drawdown"])
    assert np.allclose(a.iloc[:, 3:].astype(float), b.iloc[:, 3:].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)
