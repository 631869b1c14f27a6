"""Newest quote fields: a symbol that has most updates, disorder, repeats and restarts."""

import json
import random

from pyspark.sql import functions as F

from barloom.streaming.capture import message_stream
from barloom.streaming.quotes import PARTS, current_quotes, field_changes
from tests.test_streaming import frame, write


def update(seq, symbol, fields):
    return {"symbol": "", "timeframe": "", "seq": seq, "raw": frame({"m": "qsd", "p": ["qs", {"n": symbol, "s": "ok", "v": fields}]})}


def run(spark, folder, out, checkpoint):
    changes = field_changes(message_stream(spark, str(folder), files=1))
    changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    return spark.read.parquet(out)


def test_one_symbol_with_most_updates_is_split_by_field(spark, tmp_path):
    rng, source = random.Random(5), tmp_path / "in"
    source.mkdir()
    rows = []
    for seq in range(1, 601):
        symbol = "X:HOT" if seq % 10 else f"X:S{seq % 3}"
        rows.append((seq, symbol, {f"f{k}": rng.randint(0, 9) if rng.random() < 0.9 else None for k in rng.sample(range(40), 4)}))
    rows += [(None, "X:HOT", {"f1": 77}), (601, "X:NULLS", {"f1": None}), (602, "X:S1", {})]
    plain, newest = {}, {}
    for seq, symbol, fields in sorted((r for r in rows if r[0]), key=lambda r: r[0]):
        for field, value in fields.items():
            if value is not None:
                plain.setdefault(symbol, {})[field] = str(value)
                newest[symbol] = seq
    rng.shuffle(rows)
    for k in range(3):
        write(source, f"{k}.json", [update(*r) for r in rows[k::4]])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    run(spark, source, out, checkpoint)
    # After a restart: what is new, and what came before once more.
    write(source, "3.json", [update(*r) for r in rows[3::4] + rows[0::4]])
    changes = run(spark, source, out, checkpoint)
    got = {r.symbol: (r.seq, r.state) for r in current_quotes(changes).collect()}
    assert got == {s: (newest[s], plain[s]) for s in plain}
    assert changes.count() == changes.distinct().count()
    hot = changes.where("symbol = 'X:HOT'").select(F.pmod(F.xxhash64("field"), F.lit(PARTS)).alias("part"))
    assert hot.distinct().count() > PARTS // 2


def test_of_equal_numbers_the_greater_value_counts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.json", [update(2, "A:B", {"lp": "5"}), update(2, "A:B", {"lp": "7"}), update(1, "A:B", {"lp": "9", "bid": "1"})])
    changes = run(spark, source, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r.symbol, r.seq, json.dumps(r.state)) for r in current_quotes(changes).collect()] == [("A:B", 2, '{"bid": "1", "lp": "7"}')]
