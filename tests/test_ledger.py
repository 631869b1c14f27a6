"""The ledger's verified beginning: what an append reads, and what it refuses."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import ledger as lg

BODY = {"run_id": "r1", "status": "completed", "settings": {"costs": {}}, "trials": []}


def _append(spark, path, second):
    return lg.append_entry(spark, path, "run", "d", BODY, f"2024-01-01T00:00:{second:02d}Z")


def _text(path, seq):
    return next(p for p in (path / f"seq={seq:012d}").iterdir() if p.name.startswith("part-"))


def test_append_reads_only_what_follows_the_mark(spark, tmp_path, monkeypatch):
    path = tmp_path / "ledger"
    for second in range(3):
        _append(spark, str(path), second)
    mark = lg.read_mark(spark, str(path))
    assert mark["seq"] == 3 and lg.parts_match(spark, str(path))
    read = []
    monkeypatch.setattr(lg, "read_lines", lambda *a: read.append(a))
    assert _append(spark, str(path), 3)["prev"] == mark["hash"] and read == []
    monkeypatch.undo()
    assert lg.verify_ledger(lg.read_ledger(lg.read_lines(spark, str(path)))).first().intact


def test_entry_without_mark_is_verified_by_the_next(spark, tmp_path, monkeypatch):
    path = tmp_path / "ledger"
    _append(spark, str(path), 0)
    monkeypatch.setattr(lg, "_write_mark", lambda *a: None)
    _append(spark, str(path), 1)
    monkeypatch.undo()
    assert lg.read_mark(spark, str(path))["seq"] == 1
    assert _append(spark, str(path), 2)["seq"] == 3
    assert lg.read_mark(spark, str(path))["seq"] == 3 and lg.parts_match(spark, str(path))


def test_damage_is_refused_or_found(spark, tmp_path):
    path = tmp_path / "ledger"
    for second in range(3):
        _append(spark, str(path), second)
    last, early = _text(path, 3), _text(path, 1)
    kept = last.read_text()
    entry = json.loads(kept)
    for damaged in (kept.replace("completed", "failed"), json.dumps({**entry, "prev": lg.GENESIS}), json.dumps({**entry, "seq": 9}), "{"):
        last.write_text(damaged)
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        with pytest.raises(RuntimeError):
            _append(spark, str(path), 3)
    last.write_text(kept)
    early.write_text(early.read_text().replace("completed", "fail"))
    (early.parent / f".{early.name}.crc").unlink(missing_ok=True)
    assert not lg.parts_match(spark, str(path))
    assert lg.verify_ledger(lg.read_ledger(lg.read_lines(spark, str(path)))).first().problem == "line 1 does not match its hash"


def test_each_line_is_made_and_read_once(spark):
    """Numbering, its sample and every field took the text of a line again; a line was made dozens of times."""
    made = spark.sparkContext.accumulator(0)

    def line(n):
        made.add(1)
        return json.dumps({**BODY, "seq": n, "type": "run", "at": "2024-01-01T00:00:00Z", "dataset": "d", "prev": "p", "hash": "h"}) if n % 4 else '{"seq": 1, "seq": 2}'

    lines = spark.range(1, 41, 1, 2).select(F.col("id").cast("int").alias("line_no"), F.udf(line, T.StringType())("id").alias("value"))
    got = lg.read_ledger(lines).orderBy("line_no").collect()
    assert made.value == 40 and [r.ok for r in got] == [r.line_no % 4 > 0 for r in got]
    assert {(r.problem, r.seq) for r in got if not r.ok} == {("is not valid JSON", None)}
    assert [r.seq for r in got if r.ok] == [r.line_no for r in got if r.ok]


def test_entries_of_each_type_need_their_fields(spark):
    envelope = {"seq": 1, "at": "2024-01-01T00:00:00Z", "dataset": "d", "prev": "p", "hash": "h"}
    whole = [{**envelope, "type": kind, **{name: 1 for name in fields}} for kind, fields in lg.REQUIRED.items()]
    whole[1] |= {"settings": {"costs": {}}, "trials": []}
    bad = [{k: v for k, v in e.items() if k != name} for e in whole for name in e]
    bad += [{**whole[1], "trials": {}}, {**whole[1], "settings": {"costs": 1}}, {**whole[0], "seq": "x"}, {**whole[0], "at": "now"}, {**whole[0], "seq": None}, [whole[0]]]
    lines = spark.createDataFrame([(n, json.dumps(e)) for n, e in enumerate(whole + bad, 1)], "line_no int, value string")
    got = {r.line_no: (r.ok, r.problem) for r in lg.read_ledger(lines).collect()}
    assert [got[n][0] for n in range(1, len(whole) + 1)] == [True] * len(whole)
    assert {got[n] for n in range(len(whole) + 1, len(got) + 1)} == {(False, "is not a valid ledger entry")}
