"""Any JSON as facts, tables and series.

One pass walks each payload with a stack of its own, so that nesting has no cap, and gives a row for each scalar. A list, or
a mapping whose keys are all dates, is a table: its items share one shape, and their places are row numbers. Everything
after that is grouping by shape.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import epoch, to_number
from barloom.operators.normalise import column_types

ROOT, TIME, VALUE = "$", "time", "value"
DATE_KEY = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?Z?")
SCALAR = T.StructType().add("table", T.StringType()).add("rows", T.ArrayType(T.IntegerType())).add("path", T.StringType()).add("name", T.StringType()).add("place", T.IntegerType()).add("text", T.StringType())


class _Written(str):
    """A number as it was written."""


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return None if value is None else str(value)
    return "true" if value else "false"


def _dated(value: dict) -> bool:
    return len(value) > 1 and all(isinstance(v, dict) for v in value.values()) and all(map(DATE_KEY.fullmatch, value))


def scalars_of(payload: str | None) -> list[dict]:
    """Every scalar of a payload in the order of the text. Text that isn't JSON, or nests deeper than the JSON parser can
    go, is one fact."""
    return [dict(zip(SCALAR.names, scalar)) for scalar in _walk(payload)]


def _walk(payload: str | None) -> Iterator[tuple]:
    if payload is None:
        return
    try:
        top = json.loads(payload, parse_int=_Written, parse_float=_Written, parse_constant=_Written)
    except (ValueError, RecursionError):
        yield None, [], ROOT, VALUE, 0, payload
        return
    # (value, innermost table, row numbers, path inside it, name, place)
    stack: list[tuple] = [(top, None, (), ROOT, VALUE, 0)]
    while stack:
        value, table, rows, path, name, place = stack.pop()
        if isinstance(value, dict) and value and not _dated(value):
            inner = path if name is None or value is top else f"{path}.{name}"
            stack += reversed([(v, table, rows, inner, k, n) for n, (k, v) in enumerate(value.items())])
        elif isinstance(value, (dict, list)) and value:
            own = (path if name is None or value is top else f"{path}.{name}") + "[]"
            items = value.items() if isinstance(value, dict) else ((None, v) for v in value)
            grown = []
            for n, (key, item) in enumerate(items):
                if key is not None:
                    grown.append((key, own, (*rows, n), own, TIME, -1))
                grown.append((item, own, (*rows, n), own, None if isinstance(item, (dict, list)) else VALUE, 0))
            stack += reversed(grown)
        elif not isinstance(value, (dict, list)):
            yield table, list(rows), path, name, place, _text(value)


#: Scalars of one output batch: what a task holds doesn't grow with its payloads.
BATCH = 4096
SCALAR_ARROW = pa.schema([("table", pa.string()), ("rows", pa.list_(pa.int32())), ("path", pa.string()), ("name", pa.string()), ("place", pa.int32()), ("text", pa.string())])


def _scalar_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scalars of the last column, beside the columns before it."""
    for batch in batches:
        kept = batch.select(range(batch.num_columns - 1))
        found = ((n, *scalar) for n, payload in enumerate(batch.column(batch.num_columns - 1)) for scalar in _walk(payload.as_py()))
        while some := list(islice(found, BATCH)):
            places, *columns = zip(*some)
            beside = kept.take(pa.array(places, pa.int32())).columns if kept.num_columns else []
            values = [pa.array([None if v is None else str(v) for v in c] if pa.types.is_string(f.type) else c, f.type) for c, f in zip(columns, SCALAR_ARROW)]
            yield pa.RecordBatch.from_arrays([*beside, *values], names=[*kept.schema.names, *SCALAR_ARROW.names])


def json_scalars(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """``keep, table, rows, path, name, place, text``: ``table`` is the shape of the innermost list, ``rows`` the places in all
    lists around, ``path`` the shape of what holds the scalar. Empty lists and mappings and NULL payloads give nothing."""
    schema = T.StructType([*df.select(*keep).schema.fields, *SCALAR.fields])
    return df.select(*keep, F.col(payload).alias("_payload")).mapInArrow(_scalar_batches, schema)


def json_facts(scalars: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep, path, name, text``: the scalars outside all lists that have a value."""
    return scalars.filter("table IS NULL AND text IS NOT NULL").select(*keep, "path", "name", "text")


def json_cells(scalars: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep, table, rows, column, place, text``: the cells of all tables. What an item holds in mappings is named by the path
    inside the item."""
    inside = F.concat_ws(".", F.expr("nullif(ltrim('.', substr(path, length(table) + 1)), '')"), "name")
    return scalars.filter("table IS NOT NULL").select(*keep, "table", "rows", inside.alias("column"), "place", "text")


def json_columns(cells: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep, table, column, type``: the type of each column from all its values."""
    types = column_types(cells.select(*keep, "table", F.col("column").alias("name"), "text"), (*keep, "table"))
    return types.withColumnRenamed("name", "column")


def json_series(cells: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep, table, time, column, value``: the number columns of tables of two rows or more whose first column of dates has a
    different one in each row."""
    by = [*keep, "table"]
    typed = cells.join(json_columns(cells, keep), [*by, "column"])
    rows = cells.groupBy(*by, "rows").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("*").alias("n"))
    dates = typed.filter(F.col("type").isin("date", "datetime"))
    first = dates.groupBy(*by).agg(F.min_by("column", F.struct("place", "column")).alias("column"))
    times = dates.join(first, [*by, "column"]).select(*by, "rows", epoch(F.col("text")).alias("time"))
    whole = times.groupBy(*by).agg(F.count("time").alias("times"), F.count_distinct("time").alias("different")).join(rows, by)
    whole = whole.filter((F.col("n") > 1) & (F.col("times") == F.col("n")) & (F.col("different") == F.col("n"))).select(*by)
    numbers = typed.filter(F.col("type") == "number").select(*by, "rows", "column", to_number(F.col("text")).alias("value"))
    return numbers.join(whole, by, "left_semi").join(times, [*by, "rows"]).select(*by, "time", "column", "value")
