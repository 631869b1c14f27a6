"""Any JSON: facts, tables, series, at any depth."""

import json

import pyarrow as pa

from barloom.operators import json_shapes as js


def found(text):
    return [(s["table"], s["rows"], s["path"], s["name"], s["text"]) for s in js.scalars_of(text)]


def test_scalars_of_any_shape():
    assert found('{"a": 1.50, "b": {"c": [true, null, {"d": "x"}, [2]]}, "e": [], "f": {}}') == [
        (None, [], "$", "a", "1.50"), ("$.b.c[]", [0], "$.b.c[]", "value", "true"), ("$.b.c[]", [1], "$.b.c[]", "value", None),
        ("$.b.c[]", [2], "$.b.c[]", "d", "x"), ("$.b.c[][]", [3, 0], "$.b.c[][]", "value", "2"),
    ]
    assert found("[1]") == [("$[]", [0], "$[]", "value", "1")] and found('"x"') == [(None, [], "$", "value", "x")]
    assert found("not json") == [(None, [], "$", "value", "not json")] and found(None) == [] and found("{}") == []
    assert found('{"2024-01-02": {"p": 1}, "2024-01-03": {"p": 2}}')[2:] == [("$[]", [1], "$[]", "time", "2024-01-03"), ("$[]", [1], "$[]", "p", "2")]
    deep = '{"a":' * 300 + "7" + "}" * 300
    assert found(deep) == [(None, [], "$" + ".a" * 299, "a", "7")]
    too_deep = "[" * 200_000
    assert found(too_deep) == [(None, [], "$", "value", too_deep)]


def test_tables_and_series(spark):
    payloads = [
        (1, json.dumps({"x": {"meta": {"name": "n"}, "rows": [{"day": f"2024-01-0{k}", "v": {"close": k}, "note": "t"} for k in (1, 2, 3)]}})),
        (2, json.dumps([{"day": "2024-01-01", "v": 1}, {"day": "2024-01-01", "v": 2}])), (3, None), (4, "{}"), (5, json.dumps({"2024-01-02": {"p": 1}, "2024-01-03": {"p": "2"}})), (6, json.dumps([{"day": "2024-01-01", "v": 1}])),
    ]
    scalars = js.json_scalars(spark.createDataFrame(payloads, "id int, payload string"), keep=("id",))
    facts = [tuple(r) for r in js.json_facts(scalars, ("id",)).collect()]
    assert facts == [(1, "$.x.meta", "name", "n")]
    cells = js.json_cells(scalars, ("id",))
    types = {(r.id, r.column): r.type for r in js.json_columns(cells, ("id",)).collect()}
    assert types[1, "day"] == "date" and types[1, "v.close"] == "number" and types[1, "note"] == "text"
    series = sorted((r.id, r.table, r.time, r.column, r.value) for r in js.json_series(cells, ("id",)).collect())
    assert [s[0] for s in series] == [1, 1, 1, 5, 5] and series[0] == (1, "$.x.rows[]", 1704067200, "v.close", 1.0) and series[-1][2:] == (1704240000, "p", 2.0)


def test_scalars_come_in_small_batches():
    """A task held the scalars of all payloads of a batch as mappings."""
    payloads = [json.dumps({"k": n, "rows": [{"day": "2024-01-01", "v": i} for i in range(3000)]}) for n in range(3)] + [None, "{}", "no"]
    batch = pa.RecordBatch.from_pydict({"id": [7, 8, 9, 10, 11, None], "payload": payloads})
    got = list(js._scalar_batches([batch]))
    assert max(b.num_rows for b in got) <= js.BATCH and sum(b.num_rows for b in got) == 3 * 6001 + 1
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    want = [(i, *s.values()) for i, p in zip(batch["id"].to_pylist(), payloads) for s in js.scalars_of(p)]
    assert rows == want
    assert sum(b.num_rows for b in js._scalar_batches([batch.select(["payload"])])) == len(want)
