"""Rules as functions: contract, slices, look-ahead."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import verdict as vd
from barloom.operators.rule_functions import LookaheadError, RuleContractError, RuleFunction, checked, function_targets, probe_functions, require_honest, with_functions
from oracle.q_verdict import above_recent_mean, centred_mean, next_bar


def bars(spark, n=320):
    rng = np.random.default_rng(0)
    rows = []
    for symbol in ("A", "B"):
        close = 100 + np.cumsum(rng.normal(size=n if symbol == "A" else 40))
        rows += [(symbol, "1d", 1_700_000_000 + 86_400 * k, float(c), float(c + 1), float(c - 1), float(c), 5.0) for k, c in enumerate(close)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, t long, open double, high double, low double, close double, volume double")
    return df.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_a_rule_gives_zero_or_one_for_every_bar():
    frame = pd.DataFrame({"close": [1.0, 2.0, 3.0]})
    assert checked(RuleFunction("r", lambda b: [0, True, 1]), frame).tolist() == [0, 1, 1]
    for wrong in (lambda b: [0, 1], lambda b: 1, lambda b: [[0], [1], [1]], lambda b: [0, 1, 2], lambda b: [0, 1, np.nan], lambda b: ["a", "b", "c"], lambda b: [0, 1, None]):
        with pytest.raises(RuleContractError, match="rule r"):
            checked(RuleFunction("r", wrong), frame)
    checked(RuleFunction("r", lambda b: b.assign(close=0.0)["close"]), frame)
    assert frame["close"].tolist() == [1, 2, 3]


def test_a_broken_contract_stops_the_job_by_name(spark):
    with pytest.raises(Exception, match="RuleContractError.*rule short"):
        function_targets(bars(spark), [RuleFunction("short", lambda b: [1], 3)]).count()
    with pytest.raises(ValueError, match="differ"):
        function_targets(bars(spark), [RuleFunction("x", next_bar), RuleFunction("x", next_bar)])


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_slices_agree_with_whole_series(spark, size):
    df = bars(spark)
    whole = function_targets(df, [RuleFunction("r", above_recent_mean)])
    cut = function_targets(df, [RuleFunction("r", above_recent_mean, 4)], slice_bars=size)
    assert cut.columns == whole.columns and sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    assert whole.count() == 360


def test_cheating_rules_are_caught_and_honest_ones_are_not(spark):
    df = bars(spark)
    require_honest(df, [RuleFunction("honest", above_recent_mean)])
    for look in (None, 8):
        with pytest.raises(LookaheadError, match="centred, next"):
            require_honest(df, [RuleFunction("next", next_bar, look), RuleFunction("honest", above_recent_mean, look), RuleFunction("centred", centred_mean, look)])
    found = probe_functions(df, [RuleFunction("next", next_bar)]).collect()
    # A rule that looks one bar ahead can only change at the last bar before a cut.
    assert 0 < len(found) <= 10 and {r.rule for r in found} == {"next"}
    assert probe_functions(df.where("FALSE"), [RuleFunction("next", next_bar)]).count() == 0


def test_functions_take_the_place_of_grid_rules(spark):
    df = bars(spark, 120)
    more, rules, target_of = with_functions(df, [RuleFunction("above", above_recent_mean, 4)])
    layout = vd.plan_layout(more)
    wide = vd.fills_wide(more, vd.Costs(), rules, layout, target_of).orderBy("symbol", "ts").select("symbol", "_f0", "_h0").toPandas()
    for _, own in wide.groupby("symbol"):
        assert own["_h0"].iloc[0] == 0 and own["_h0"].iloc[1:].tolist() == own["_f0"].iloc[:-1].tolist()
