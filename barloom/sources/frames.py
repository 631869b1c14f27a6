"""Captured websocket text -> protocol frames -> bars and quotes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import FIELDS, ORDER
from barloom.sources.ohlcv import is_valid_bar

HEADER = re.compile(rb"~m~(\d+)~m~")
HEARTBEAT = "~h~"


def _usable(chunk: bytes) -> str | None:
    try:
        text = chunk.decode("utf-8")
        if not text.startswith(HEARTBEAT):
            json.loads(text)
        return text
    except ValueError:
        return None


def split_frames(raw: str) -> list[str]:
    """Payloads of one captured message. Lengths count bytes; a wrong length falls back to the next header."""
    data, found, position = raw.encode("utf-8"), [], 0
    while header := HEADER.search(data, position):
        begin = header.end()
        end = begin + int(header.group(1))
        text = _usable(data[begin:end]) if end <= len(data) else None
        if text is not None:
            position = end
        else:
            following = HEADER.search(data, begin)
            if following or end > len(data):
                text = _usable(data[begin : following.start() if following else len(data)])
            position = following.start() if following else len(data)
        if text is not None:
            found.append(text)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def frame_payloads(raw: pd.Series) -> pd.Series:
    return raw.map(lambda text: [] if text is None else split_frames(text))


def parse_frames(messages: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """(method, payload JSON array) per frame; heartbeats and non-objects are skipped."""
    frames = messages.select(*keep, F.explode(frame_payloads(raw)).alias("frame")).filter(~F.col("frame").startswith(HEARTBEAT))
    parsed = frames.withColumn("f", F.from_json("frame", "m STRING, p STRING"))
    return parsed.filter(F.col("f.m").isNotNull()).select(*keep, F.col("f.m").alias("method"), F.col("f.p").alias("payload"))


def bars_from_frames(frames: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(session, ts, fields, source index) of candle frames, with the loader's validity rules."""
    candles = frames.filter(F.col("method").isin("du", "timescale_update"))
    body = F.from_json("payload", "ARRAY<STRING>")
    series = F.from_json(F.try_element_at(body, F.lit(2)), "MAP<STRING, STRING>")
    rows = F.from_json(F.col("series"), "s ARRAY<STRUCT<i: STRING, v: ARRAY<STRING>>>")
    flat = (
        candles.select(*keep, F.try_element_at(body, F.lit(1)).alias("session"), F.explode(series).alias("name", "series"))
        .select(*keep, "session", F.explode(rows["s"]).alias("bar"))
        .filter(F.size("bar.v") >= 5)
    )
    number = lambda i: F.try_element_at(F.col("bar.v"), F.lit(i)).try_cast("double")
    raw_volume = F.try_element_at(F.col("bar.v"), F.lit(6))
    volume = F.when(raw_volume.isNull() | (raw_volume == ""), 0.0).otherwise(raw_volume.try_cast("double"))
    typed = flat.select(
        *keep, "session", F.timestamp_seconds(F.when(number(1) > 0, F.floor(number(1)))).alias(ORDER),
        *(number(i + 2).alias(name) for i, name in enumerate(FIELDS[:4])), volume.alias("volume"), F.col("bar.i").alias("source_index"),
    )
    return typed.filter(is_valid_bar())


def symbol_of(name: Column) -> Column:
    """A quote's symbol: plain, or inside an encoded ``={json}`` name."""
    encoded = F.regexp_replace(name, "^=", "")
    inner = F.get_json_object(encoded, "$.symbol")
    return F.when(~encoded.startswith("{"), name).otherwise(F.coalesce(F.when(inner != "", inner), name))


class _Number(str):
    """A number as it was written."""


def _plain(value) -> str | None:
    if value is None or isinstance(value, str):
        return None if value is None else str(value)
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def quote_records(payload: str | None) -> list[dict]:
    """Name and values of every quote record in a message, at any depth. A record without a name of its own takes that of
    the nearest key around it that looks like ``EXCHANGE:SYMBOL``."""
    try:
        items = json.loads(payload or "null", parse_int=_Number, parse_float=_Number)
    except (ValueError, RecursionError):
        return []
    out: list[dict] = []
    stack = [(item, None) for item in reversed(items[1:])] if isinstance(items, list) else []
    while stack:
        item, hint = stack.pop()
        if not isinstance(item, dict):
            continue
        name = _plain(item.get("n")) or _plain(item.get("symbol")) or hint
        if name is not None and isinstance(item.get("v"), dict):
            out.append({"name": name, "values": {k: _plain(v) for k, v in item["v"].items()}})
        inner = [(v, k if ":" in k else hint) for k, v in item.items() if k not in ("v", "n", "symbol", "s") and isinstance(v, dict)]
        stack += reversed(inner)
    return out


QUOTE = T.StructType().add("name", T.StringType()).add("values", T.MapType(T.StringType(), T.StringType()))


@F.pandas_udf(T.ArrayType(QUOTE))
def _quotes(payload: pd.Series) -> pd.Series:
    return payload.map(quote_records)


def quotes_from_frames(frames: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, values) per quote record; records may nest to any depth under names like ``EXCHANGE:SYMBOL``."""
    found = frames.filter(F.col("method") == "qsd").select(*keep, F.explode(_quotes("payload")).alias("q"))
    return found.select(*keep, symbol_of(F.col("q.name")).alias("symbol"), F.col("q.values").alias("values")).filter(F.col("symbol").isNotNull())


#: Fields that one state may have; more of them are taken for damaged input.
MOST_FIELDS = 1000


def merge_quotes(updates: DataFrame, order: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Full state after each update: every field keeps its last value per symbol (batch replay). Without ``fields`` those
    of all updates count; they are read first."""
    if fields is None:
        names = updates.select(F.explode(F.map_keys("values")).alias("k")).distinct().limit(MOST_FIELDS + 1).collect()
        if len(names) > MOST_FIELDS:
            raise ValueError(f"more than {MOST_FIELDS} quote fields")
        fields = tuple(sorted(r.k for r in names))
    day = F.date_trunc("day", order)
    slice_ = Window.partitionBy("symbol", "_day").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    tagged = updates.withColumn("_day", day)
    # A symbol's day is one window; what earlier days leave behind is one row per symbol and day.
    closing = tagged.groupBy("symbol", "_day").agg(
        *(F.max_by(F.col("values")[n], F.when(F.col("values")[n].isNotNull(), F.col(order))).alias(f"_c{i}") for i, n in enumerate(fields))
    )
    opening = closing.select("symbol", "_day", *(F.last(f"_c{i}", ignorenulls=True).over(earlier).alias(f"_o{i}") for i in range(len(fields))))
    joined = tagged.join(opening, ["symbol", "_day"])
    pairs = F.array(*(
        F.struct(F.lit(n).alias("k"), F.coalesce(F.last(F.col("values")[n], ignorenulls=True).over(slice_), F.col(f"_o{i}")).alias("v")) for i, n in enumerate(fields)
    ))
    state = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    return joined.withColumn("state", state).drop("_day", *(f"_o{i}" for i in range(len(fields))))


def render_quote(symbol: Column, values: Column, received: Column, form: str = "text", price_only: bool = False) -> Column:
    """A quote as text or JSON, or only its last price."""
    if price_only:
        return F.coalesce(values["lp"], F.lit(""))
    if form == "json":
        return F.to_json(F.map_concat(F.create_map(F.lit("symbol"), symbol, F.lit("received_at"), received), values))
    if form != "text":
        raise ValueError("form must be 'text' or 'json'")
    return F.concat_ws(" ", symbol, F.concat_ws(" ", F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))))
