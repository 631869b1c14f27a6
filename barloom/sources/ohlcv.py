"""OHLCV tables from text files: parsing, validation, catalogue."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import csv_fields
from barloom.schema import FIELDS, KEYS, ORDER, PRICES, finite

REQUIRED = ("time", *FIELDS)


def parse_time(text: Column, naive_zone: str = "Asia/Kolkata") -> Column:
    """A timestamp from capture text: epochs by digit count, the weekday form, slashes, ISO."""
    clean = F.regexp_replace(F.trim(text.cast("string")), r" \([^)]*\)$", "")
    sign = F.when(clean.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(clean, r"^[+-]+", "")
    number = F.when(digits.rlike(r"^\d+$"), digits.try_cast("long") * sign)
    size = F.length(digits)
    epoch = (
        F.when(size == 10, F.timestamp_seconds(number)).when(size == 13, F.timestamp_millis(number))
        .when(size == 16, F.timestamp_micros(number)).when(size == 19, F.timestamp_micros(F.floor(number / 1000)))
    )
    # The weekday is dropped: a pattern with one makes even the lenient parser raise.
    weekday = r"^[A-Za-z]{3} ([A-Za-z]{3} \d{1,2} \d{4} \d{2}:\d{2}:\d{2}) GMT([+-]\d{2}):?(\d{2})$"
    worded = F.when(clean.rlike(weekday), F.regexp_replace(clean, weekday, "$1 $2$3"))
    local = lambda form: F.to_utc_timestamp(F.try_to_timestamp(clean, F.lit(form)), naive_zone)
    iso = F.when(clean.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & clean.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(clean))
    naive = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), F.to_utc_timestamp(F.try_to_timestamp(clean), naive_zone))
    return F.when(number.isNotNull(), epoch).otherwise(
        F.coalesce(F.try_to_timestamp(worded, F.lit("MMM d yyyy HH:mm:ss Z")), local("yyyy/MM/dd, HH:mm:ss"), iso, naive)
    )


def is_valid_bar() -> Column:
    """Present finite values, positive prices, non-negative volume, high and low on the right sides."""
    present = F.col(ORDER).isNotNull()
    for name in FIELDS:
        present = present & F.col(name).isNotNull()
    for name in PRICES:
        present = present & (F.col(name) > 0)
    return F.coalesce(
        present & (F.col("volume") >= 0) & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high")),
        F.lit(False),
    )


def validate(raw: DataFrame, position: Column, naive_zone: str = "Asia/Kolkata", keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Typed bars and per-series counts from text rows (key columns, ``time`` and the five fields).

    ``position`` orders the rows of a file: the last row of a repeated timestamp wins. The duplicates of
    one timestamp combine on the map side, so no window over a whole series is needed.
    """
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    typed = raw.select(
        *keys, parse_time(F.col("time"), naive_zone).alias(ORDER),
        *(finite(F.trim(F.col(c).cast("string")).try_cast("double")).alias(c) for c in FIELDS), position.alias("_at"),
    ).withColumn("_ok", is_valid_bar())
    bars = typed.filter("_ok").groupBy(*keys, ORDER).agg(F.max_by(F.struct(*FIELDS), "_at").alias("b"), F.count(F.lit(1)).alias("_n"))
    kept = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("valid_rows"))
    counts = typed.groupBy(*keys).agg(F.count(F.lit(1)).alias("input_rows"), F.count_if(~F.col("_ok")).alias("dropped_rows")).join(kept, list(keys), "left")
    counts = counts.fillna(0, ["valid_rows"]).withColumn("duplicate_rows", F.col("input_rows") - F.col("dropped_rows") - F.col("valid_rows"))
    return bars.select(*keys, ORDER, "b.*"), counts


SEPARATORS = (",", ";", "\t")
#: Header names that stand for the time of a bar, in order of preference.
TIME_NAMES = ("time", "timestamp", "datetime", "date")
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*"


def _identity(path: Column, root: str, encoded: bool = True) -> tuple[Column, Column]:
    """Symbol and timeframe of ``<symbol>/<timeframe>.csv``; a file directly in the folder is a symbol without timeframe."""
    base = re.sub(_SCHEME, "/", root).rstrip("/")
    base = quote(base) if encoded else base
    plain = F.regexp_replace(path, _SCHEME, "/")
    inside = F.when(plain.startswith(base + "/"), F.substring(plain, len(base) + 2, 1 << 20))
    name, parent = F.regexp_extract(path, r"([^/]+)\.csv$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    flat = F.coalesce(~inside.contains("/"), F.lit(False))
    decoded = F.url_decode if encoded else (lambda c: c)
    return decoded(F.when(flat, name).otherwise(parent)), decoded(F.when(~flat, name))


def file_headers(lines: DataFrame, separator: str | None = None) -> DataFrame:
    """``file, separator, names`` of each file of ``lines``: its first line, cut by the given separator or the most
    frequent one outside quotes. Names are lower-case; the first known name of a time column becomes ``time``."""
    head = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "n")).alias("head"))
    head = head.withColumn("head", F.regexp_replace("head", "^\ufeff|\r$", ""))
    bare = F.regexp_replace("head", '"[^"]*"', "")
    counts = [F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) for s in SEPARATORS]
    found = F.lit(separator) if separator else F.when((counts[0] >= counts[1]) & (counts[0] >= counts[2]), ",").when(counts[1] >= counts[2], ";").otherwise("\t")
    cut = F.when(F.col("separator") == ";", csv_fields(F.col("head"), ";")).when(F.col("separator") == "\t", csv_fields(F.col("head"), "\t")).otherwise(csv_fields(F.col("head"), ","))
    named = head.withColumn("separator", found).select("file", "separator", F.transform(cut, F.lower).alias("names"))
    alias = F.coalesce(*(F.when(F.array_contains("names", n), n) for n in TIME_NAMES), F.lit("time"))
    return named.select("file", "separator", F.transform("names", lambda n: F.when(n == alias, "time").otherwise(n)).alias("names"))


def _read(spark: SparkSession, path: str, naive_zone: str, separator: str | None) -> tuple[DataFrame, DataFrame]:
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    headers = file_headers(lines, separator)
    whole = headers.agg(F.count("*").alias("n"), F.count_if(F.array_size(F.array_except(F.array(*map(F.lit, REQUIRED)), "names")) == 0).alias("good"), F.max(F.array_join(F.array_except(F.array(*map(F.lit, REQUIRED)), "names"), ", ")).alias("missing")).first()
    if whole.n and not whole.good:
        raise ValueError(f"missing required columns: {whole.missing}")
    first = lines.groupBy("file").agg(F.min(F.struct("block", "n")).alias("first"))
    rows = lines.join(headers, "file").join(first, "file").where((F.struct("block", "n") != F.col("first")) & (F.trim(F.regexp_replace("value", "\r$", "")) != ""))
    line = F.regexp_replace("value", "\r$", "")
    cells = F.when(F.col("separator") == ";", csv_fields(line, ";")).when(F.col("separator") == "\t", csv_fields(line, "\t")).otherwise(csv_fields(line, ","))
    symbol, timeframe = _identity(F.col("file"), path)
    cut = rows.withColumn("cells", cells)
    raw = cut.select(symbol.alias("symbol"), F.coalesce(timeframe, F.lit("")).alias("timeframe"), *(F.try_element_at("cells", F.nullif(F.array_position("names", name), F.lit(0)).cast("int")).alias(name) for name in REQUIRED), F.struct("file", "block", "n").alias("_at"))
    return validate(raw, F.col("_at"), naive_zone)


def read_ohlcv(spark: SparkSession, path: str, naive_zone: str = "Asia/Kolkata", sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """Bars and counts of ``<symbol>/<timeframe>.csv`` files under a folder (or one file).

    Columns are found by the header of each file, in any order. The rows of a file without a required column are
    dropped and counted; a folder in which every file lacks one is an error. The bars of a file directly in the folder
    have an empty timeframe, so that the keys of a series can be compared.
    """
    return _read(spark, path, naive_zone, sep)


def read_ohlcv_loose(spark: SparkSession, path: str, naive_zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """As ``read_ohlcv`` for foreign files: a separator, column order and letter case of each file's own, BOM and CRLF."""
    return _read(spark, path, naive_zone, None)


def dataset_catalog(spark: SparkSession, path: str) -> DataFrame:
    """CSV files under a folder with symbol and timeframe; hidden files are skipped by the reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    symbol, timeframe = _identity(F.col("path"), path, encoded=False)
    return files.select("path", symbol.alias("symbol"), timeframe.alias("timeframe"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def dataset_identity(catalog: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Symbol and timeframe from the sidecar (path, symbol, timeframe) where there is one, else from the path."""
    named = sidecars.select("path", F.col("symbol").alias("_s"), F.col("timeframe").alias("_t"))
    joined = catalog.join(named, "path", "left")
    return joined.select("path", F.coalesce("_s", "symbol").alias("symbol"), F.coalesce("_t", "timeframe").alias("timeframe"), *(c for c in catalog.columns if c not in ("path", "symbol", "timeframe")))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("schema_version int, symbol string, timeframe string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv.meta.json").json(path)
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", "").alias("path"), "symbol", "timeframe")


def dataset_summary(catalog: DataFrame, bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows and time range of each catalogued dataset; those without a valid row carry an error."""
    found = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(ORDER).alias("start"), F.max(ORDER).alias("end"))
    # A flat file has no timeframe in the catalogue and an empty one in its bars.
    known = catalog.withColumns({k: F.coalesce(k, F.lit("")) for k in keys})
    joined = known.join(found, list(keys), "left").withColumns({k: F.nullif(F.col(k), F.lit("")) for k in keys}).withColumn("valid", F.col("rows").isNotNull()).fillna(0, ["rows"])
    return joined.withColumn("error", F.when(~F.col("valid"), F.lit("contains no valid OHLCV rows"))).orderBy(*keys)


def latest_per_timestamp(bars: DataFrame, version: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The last version of each (series, timestamp)."""
    rest = [c for c in bars.columns if c not in (*keys, ORDER)]
    return bars.groupBy(*keys, ORDER).agg(F.max_by(F.struct(*rest), version).alias("_b")).select(*keys, ORDER, "_b.*")
