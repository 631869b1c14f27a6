"""Filters, quantiles, loaders, frames, ledger, statistics on small fixtures."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.statistics import cdf, ppf
from barloom.operators import filters as fl
from barloom.operators import ledger as lg
from barloom.operators import verdict as vd
from barloom.operators.joins import unique_labels
from barloom.operators.quantiles import key_quantiles
from barloom.sources.frames import split_frames
from barloom.sources.ohlcv import read_ohlcv, read_ohlcv_loose


def test_narrowed_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(size=5000)] + [("ties", float(x)) for x in rng.integers(0, 3, 2000)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.5, "b": 0.995, "c": 0.0}
    got = {r.k: r for r in key_quantiles(df, ["k"], "v", probs, bounded=False, small=50).collect()}
    for key in ("hot", "ties", "one"):
        values = [v for k, v in rows if k == key]
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)


def test_csv_loader(spark, tmp_path):
    folder = tmp_path / "NSE_X"
    folder.mkdir()
    line = "[{i}],Mon Jan 01 2024 09:{m}:00 GMT+0530,{o},{h},{l},{c},{v}".format
    body = [line(i=i, m=15 + i, o=100 + i, h=102 + i, l=99 + i, c=101 + i, v=100 + i) for i in range(40)]
    body += [line(i=7, m=22, o=107, h=110, l=106, c=109, v=1), line(i=41, m=56, o=5, h=1, l=9, c=5, v=1), line(i=42, m=57, o="inf", h="inf", l=1, c=2, v=1)]
    (folder / "1.csv").write_text("index,time,open,high,low,close,volume\n" + "\n".join(body) + "\n")
    bars, counts = read_ohlcv(spark, str(tmp_path))
    c = counts.first()
    assert (c.symbol, c.timeframe, c.valid_rows, c.duplicate_rows, c.dropped_rows) == ("NSE_X", "1", 40, 1, 2)
    assert bars.filter("open = 107").first().close == 109
    assert bars.agg(F.unix_seconds(F.min("ts"))).first()[0] == 1704080700


def test_loose_loader(spark, tmp_path):
    path = tmp_path / "loose.csv"
    path.write_text("Close;Date;Open;High;Low;Volume\r\n2;2024-01-02;1;3;0.5;10\r\n2;2024-01-03;1;3;0.5;\r\n")
    bars, counts = read_ohlcv_loose(spark, str(path))
    assert bars.count() == 1 and counts.first().dropped_rows == 1


def test_frames():
    assert split_frames('~m~4~m~~h~1~m~7~m~{"a":1}junk~m~99~m~{"b":"é"}') == ["~h~1", '{"a":1}', '{"b":"é"}']
    assert split_frames('~m~2~m~{"a":1}~m~7~m~{"b":2}') == ['{"a":1}', '{"b":2}']


def test_filter_helpers():
    raw = {"type": "group", "mode": "or", "children": [{"type": "condition", "field": "close", "op": "gt", "value": "x"}, {"type": "condition", "field": "a", "op": "nope"}, 3]}
    tree, dropped = fl.normalize_tree(raw)
    assert dropped == 2 and len(tree["children"]) == 1 and tree["children"][0]["value"] == 0.0
    tree = fl.all_of(fl.condition("rsi", "between", 70, 30), fl.any_of(fl.condition("v", "top_pct", 10), negate=True))
    assert fl.describe(tree) == "(rsi within limits 30 and 70) AND (NOT (v among the largest 10 percent))"
    assert fl.count_active(tree) == 2 and fl.uses_lookahead(tree)


def test_ledger_chain(spark, tmp_path):
    path = str(tmp_path / "ledger")
    body = {"run_id": "r1", "status": "completed", "settings": {"costs": {}}, "trials": [{"key": "d::a", "rule_id": "a"}]}
    for second in ("00", "01"):
        lg.append_entry(spark, path, "run", "d", body, f"2024-01-01T00:00:{second}Z")
    lines = lg.read_lines(spark, path)
    assert lg.verify_ledger(lg.read_ledger(lines)).first().intact
    assert lg.trials(lg.read_ledger(lines)).first().runs == 2
    broken = lines.withColumn("value", F.when(F.col("line_no") == 2, F.replace("value", F.lit("completed"), F.lit("failed"))).otherwise(F.col("value")))
    assert lg.verify_ledger(lg.read_ledger(broken)).first().problem == "line 2 does not match its hash"


def test_unique_labels(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x-2"), (4, "x"), (5, "y")], "i int, label string")
    assert [r.unique_label for r in unique_labels(df, "label", "i").orderBy("i").collect()] == ["x", "x-3", "x-2", "x-4", "y"]


def test_normal_functions():
    for p in (1e-6, 0.01, 0.3, 0.5, 0.9, 0.999):
        assert cdf(ppf(p)) == pytest.approx(p, rel=1e-12)


def test_bootstrap_blocks_cover_each_replicate(spark):
    series = spark.createDataFrame([("a", 500, 8, 1), ("b", 37, 3, 2)], "symbol string, n long, block int, seed long")
    blocks = vd.drawn_blocks(series, ["symbol"], 50)
    sizes = blocks.groupBy("symbol", "replicate").agg(F.sum("length").alias("rows")).groupBy("symbol").agg(F.min("rows").alias("lo"), F.max("rows").alias("hi"), F.count("rows").alias("n"))
    assert {(r.symbol, r.lo, r.hi, r.n) for r in sizes.collect()} == {("a", 500, 500, 50), ("b", 37, 37, 50)}
    again = vd.drawn_blocks(series, ["symbol"], 50)
    assert blocks.agg(F.sum(F.xxhash64("*") % 1000003)).first()[0] == again.agg(F.sum(F.xxhash64("*") % 1000003)).first()[0]
    # The signed prefix positions of a replicate add up to its draws.
    x = np.arange(500.0) ** 1.5
    prefix = np.concatenate([[0.0], np.cumsum(x)])
    one = blocks.filter("symbol = 'a' AND replicate = 7")
    ends = vd.block_ends(one, ["symbol"]).collect()
    drawn = sum(x[(np.arange(r.start, r.start + r.length)) % 500].sum() for r in one.collect())
    assert sum(r.sign * prefix[r._upto] for r in ends) == pytest.approx(drawn)


def test_stepdown_against_brute_force(spark):
    rng = np.random.default_rng(5)
    means = rng.normal([0.0, 0.1, 0.3], [1, 0.5, 0.2], size=(400, 3))
    observed = np.array([0.2, 0.9, 0.5])
    rows = [("a", r, j, float(means[r, j])) for r, j in itertools.product(range(400), range(3))] + [("a", r, -1, 0.0) for r in range(400)]
    draws = spark.createDataFrame(rows, "symbol string, replicate int, rule_no int, mean double")
    tested = spark.createDataFrame([("a", j, 0.0, float(observed[j])) for j in range(3)], "symbol string, rule_no int, exposure double, excess double")
    got = {r.rule_no: r.adjusted_p for r in vd.stepdown(draws, tested, ["symbol"]).collect()}
    sigma = means.std(axis=0, ddof=1)
    stat, null = observed / sigma, (means - observed) / sigma
    floor, want = 0.0, {}
    left = list(np.argsort(-stat))
    while left:
        j = left[0]
        floor = max(floor, float(np.mean(null[:, left].max(axis=1) >= stat[j])))
        want[j] = floor
        left = left[1:]
    for j in range(3):
        assert got[j] == pytest.approx(want[j])


def test_entry_points_need_no_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 250
    assert json.dumps(sorted(entry.oracle_sql()))
