"""Nearest bars: a dense day, ties, repeats, NULLs and keys without bars."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barloom.operators.joins import nearest, time_slices

START = datetime(2024, 1, 1)


def plain(points, bars):
    out = []
    for key, at in points:
        own = [b for b in bars if b[0] == key and b[1] is not None]
        best = min(own, key=lambda b: (abs((b[1] - at).total_seconds()), b[1], b[2] is None, -(b[2] or 0))) if own and at else None
        out.append((key, at, best and int((best[1] - datetime(1970, 1, 1)).total_seconds()), best and best[2]))
    return sorted(out, key=repr)


def tables(spark, points, bars):
    return spark.createDataFrame(points, "k string, ts timestamp_ntz").repartition(5), spark.createDataFrame(bars, "k string, ts timestamp_ntz, close double").repartition(5)


def test_a_dense_day_is_split_and_agrees_with_plain_search(spark):
    rng = random.Random(9)
    at = lambda days: START + timedelta(seconds=rng.randrange(int(days * 86_400)))
    points = [("hot", at(1)) for _ in range(900)] + [(k, at(400)) for k in ("a", None, "alone") for _ in range(40)] + [("hot", None), ("far", START)]
    bars = [("hot", at(1), float(rng.randint(0, 99))) for _ in range(60)] + [(k, at(400), float(rng.randint(0, 99))) for k in ("a", None) for _ in range(30)]
    # Two bars of one time, bars as far before as after, a bar without time or value, and one far from all points of its key.
    bars += [(k, t, 100.0 - v) for k, t, v in bars[:20]] + [(k, t + timedelta(seconds=s), 1.0) for k, t in points[:20] for s in (-7, 7)]
    bars += [("hot", None, 5.0), ("hot", START + timedelta(days=2), None), ("far", START + timedelta(days=3000), 3.0)]
    points += points[:30]
    p, b = tables(spark, points, bars)
    for slices in (None, 1, 12):
        got = [(r.k, r.ts, r.nearest_time, r.close) for r in nearest(p, b, ["k"], "ts", "close", slices).collect()]
        assert sorted(got, key=repr) == plain(points, bars)
    day = time_slices(p, b, ["k"], "ts", "close", 12).where("k = 'hot' AND _t < unix_seconds(TIMESTAMP '2024-01-02 00:00:00')")
    sizes = [r["count"] for r in day.groupBy("_slice").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 3 * len(points + bars) / 12


def test_empty_sides(spark):
    p, b = tables(spark, [("a", START)], [("a", START, 1.0)])
    assert nearest(p.limit(0), b, ["k"], "ts", "close").collect() == []
    assert [tuple(r) for r in nearest(p, b.where(F.lit(False)), ["k"], "ts", "close").collect()] == [("a", START, None, None)]
