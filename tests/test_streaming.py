"""Streaming capture: forming bars, late bars, restarts, quote state."""

import json

from pyspark.sql import functions as F

from barloom.sources.sinks import read_store
from barloom.streaming.capture import capture_bars, merged_quotes, message_stream


def frame(payload) -> str:
    text = json.dumps(payload)
    return f"~m~{len(text.encode())}~m~{text}"


def bar(ts, close, seq):
    body = {"m": "du", "p": ["cs", {"sds_1": {"s": [{"i": seq, "v": [ts, 10, 20, 5, close]}]}}]}
    return {"symbol": "X", "timeframe": "1", "seq": seq, "raw": frame(body)}


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_bars_are_replaced_and_late_bars_inserted(spark, tmp_path):
    source, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    source.mkdir()
    write(source, "a.json", [bar(1704067200, 11, 1), bar(1704067200, 12, 2), bar(1704067260, 13, 3)])
    capture_bars(message_stream(spark, str(source)), store, checkpoint).awaitTermination(120)
    write(source, "b.json", [bar(1704067260, 14, 4), bar(1703980800, 9, 5)])
    capture_bars(message_stream(spark, str(source)), store, checkpoint).awaitTermination(120)
    # A restart without new input changes nothing.
    capture_bars(message_stream(spark, str(source)), store, checkpoint).awaitTermination(120)
    got = [(r.t, r.close) for r in read_store(spark, store).select(F.unix_seconds("ts").alias("t"), "close").orderBy("t").collect()]
    assert got == [(1703980800, 9.0), (1704067200, 12.0), (1704067260, 14.0)]


def test_quotes_merge_per_symbol(spark, tmp_path):
    source = tmp_path / "q"
    source.mkdir()
    quote = lambda seq, fields: {"symbol": "", "timeframe": "", "seq": seq, "raw": frame({"m": "qsd", "p": ["qs", {"n": '={"symbol":"A:B"}', "s": "ok", "v": fields}]})}
    write(source, "a.json", [quote(1, {"lp": 1, "bid": 2}), quote(2, {"ask": 3})])
    stream = merged_quotes(message_stream(spark, str(source)))
    query = stream.writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("merged").orderBy("seq").collect()
    assert [r.symbol for r in rows] == ["A:B", "A:B"]
    assert json.loads(rows[1].state) == {"lp": "1", "bid": "2", "ask": "3"}
