"""Provider JSON and CSV bodies as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import csv_fields, epoch, strip_prefix, to_number

RECORDS, MAPPING = "ARRAY<STRING>", "MAP<STRING, STRING>"


def records_by_symbol(payload: Column, plural: str, singular: str) -> Column:
    """Array of (symbol, record JSON) from any of the three shapes a provider uses.

    ``{plural: {sym: [..]}}``, ``{plural: [..], symbol}`` or ``{singular: {..}, symbol}``; a symbol's value
    may also be one record.
    """
    many, one = F.get_json_object(payload, f"$.{plural}"), F.get_json_object(payload, f"$.{singular}")
    symbol = F.get_json_object(payload, "$.symbol")
    listed = lambda name, text: F.transform(F.from_json(text, RECORDS), lambda r: F.struct(name.alias("symbol"), r.alias("record")))
    keyed = F.flatten(F.transform(
        F.map_entries(F.from_json(many, MAPPING)),
        lambda e: F.when(e["value"].startswith("["), listed(e["key"], e["value"])).otherwise(F.array(F.struct(e["key"].alias("symbol"), e["value"].alias("record")))),
    ))
    return F.when(many.startswith("{"), keyed).when(many.startswith("["), listed(symbol, many)).when(
        one.startswith("{"), F.array(F.struct(symbol.alias("symbol"), one.alias("record")))
    )


def time_keyed_to_series(df: DataFrame, payload: str, zone: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``{"2024-01-02": {"1. open": "220.8"}}`` -> (time, name, value); names lose their number prefix."""
    outer = df.select(*keep, F.explode(F.from_json(payload, MAPPING)).alias("_day", "_cells"))
    inner = outer.select(*keep, epoch(F.col("_day"), zone).alias("time"), F.explode(F.from_json("_cells", MAPPING)).alias("_name", "_value"))
    return inner.select(*keep, "time", strip_prefix(F.col("_name")).alias("name"), to_number(F.col("_value")).alias("value")).filter(F.col("time").isNotNull())


def columnar_to_rows(df: DataFrame, arrays: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """Parallel arrays -> rows; shorter or absent arrays are padded with NULL."""
    named = df.select(*keep, *(F.coalesce(c, F.array()).alias(n) for n, c in arrays.items()))
    return named.select(*keep, F.explode(F.arrays_zip(*arrays)).alias("_r")).select(*keep, "_r.*")


def csv_payload(df: DataFrame, body: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A CSV body -> one map per line, named by the body's header. Quotes protect commas; cells that a line lacks are
    NULL, those beyond the header are left out, and of names that repeat the first counts."""
    lines = F.filter(F.split(F.regexp_replace(F.col(body), "\ufeff|\r", ""), "\n"), lambda x: F.trim(x) != "")
    parsed = df.select(*keep, csv_fields(F.try_element_at(lines, F.lit(1))).alias("_h"), F.posexplode(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(0)))).alias("line", "_l"))
    parsed = parsed.select(*keep, "line", "_h", csv_fields(F.col("_l")).alias("_c"))
    record = F.map_from_entries(F.transform(F.array_distinct("_h"), lambda n: F.struct(n, F.get("_c", (F.array_position("_h", n) - 1).cast("int")))))
    return parsed.select(*keep, "line", record.alias("record"))


def sentiment_from_json(payloads: DataFrame, payload: str = "payload", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(readings, counts) from index payloads: failed payloads are skipped, later rows replace earlier ones. ``order`` tells
    which payload is the later one, where they are pages of one series."""
    ok = F.coalesce(F.get_json_object(payload, "$.status.error_code"), F.lit("0")) == "0"
    rows = payloads.filter(ok).select((F.col(order) if order else F.lit(0)).alias("page"), F.posexplode(F.from_json(F.get_json_object(payload, "$.data.dataList"), RECORDS)).alias("pos", "r"))
    field = lambda name: to_number(F.get_json_object("r", f"$.{name}"))
    typed = rows.select(F.struct("page", "pos").alias("pos"), field("timestamp").alias("t"), field("score").alias("s"), field("btcPrice").alias("btc_price"), field("btcVolume").alias("btc_volume"))
    good = F.coalesce((F.col("t") > 0) & (F.col("s") == F.floor("s")) & F.col("s").between(0, 100), F.lit(False))
    counts = typed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~good).alias("dropped_rows"))
    kept = typed.filter(good).groupBy(F.floor("t").alias("time")).agg(F.max_by(F.struct(F.col("s").cast("int").alias("score"), "btc_price", "btc_volume"), "pos").alias("b"))
    return kept.select("time", "b.*"), counts
