"""Sealed holdouts: the last share of a series is kept back and read once, for frozen rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.backtest import Rule
from barloom.operators.downsample import numbered
from barloom.operators.layout import Layout, plan_layout
from barloom.operators.verdict import Costs, fills, window_summary
from barloom.schema import FIELDS

MIN_BARS = 100
MIN_FRACTION, MAX_FRACTION, DEFAULT_FRACTION = 0.10, 0.30, 0.20
DIGEST_ROWS = 65_536


def fingerprint(df: DataFrame, fraction: float, layout: Layout | None = None) -> DataFrame:
    """Digest of the ordered times and values of each series and its identity.

    Rows are digested in blocks of fixed size by index, then the block digests in order, so no task
    strings together a whole series. A change of any value, time or order changes the digest.
    """
    rows, keys = numbered(df, layout)
    order = (layout or Layout()).order
    text = F.concat_ws("|", F.unix_micros(F.col(order).cast("timestamp")).cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS))
    blocks = rows.groupBy(*keys, F.floor(F.col("_i") / DIGEST_ROWS).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_i", text.alias("t")))).alias("_rows"), F.min(order).alias("_first"))
    digests = blocks.select(*keys, "_b", "_first", F.sha2(F.array_join("_rows.t", "\n"), 256).alias("_d"))
    whole = digests.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.struct("_b", "_d")))["_d"], "\n").alias("_all"), F.min("_first").alias("_start"))
    identity = F.concat_ws("|", F.unix_seconds(F.col("_start").cast("timestamp")).cast("string"), *keys, F.lit(repr(fraction)))
    return whole.select(*keys, F.sha2(F.concat_ws("\n", "_all", identity), 256).alias("fingerprint"))


def plan_seal(df: DataFrame, fraction: float = DEFAULT_FRACTION, layout: Layout | None = None) -> DataFrame:
    """One seal per series with at least 100 bars: where the holdout starts, its size, the research digest."""
    if not MIN_FRACTION <= fraction <= MAX_FRACTION:
        raise ValueError(f"fraction must be between {MIN_FRACTION} and {MAX_FRACTION}")
    rows, keys = numbered(df, layout)
    order = (layout or Layout()).order
    rows = rows.withColumn("_research", F.floor(F.round(F.col("_n") * (1 - fraction), 9))).filter(F.col("_n") >= MIN_BARS)
    seals = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("_i") == F.col("_research"), F.col(order))).alias("holdout_start"), F.max(order).alias("holdout_end"),
        (F.max("_n") - F.max("_research")).alias("holdout_bars"), F.max("_research").alias("research_bars"),
    )
    research = rows.filter(F.col("_i") < F.col("_research")).select(*df.columns)
    return seals.join(fingerprint(research, fraction, layout), keys).withColumn("fraction", F.lit(fraction))


def research_window(df: DataFrame, seals: DataFrame, keys: Sequence[str] = Layout().keys, order: str = Layout().order) -> DataFrame:
    """Bars strictly before the holdout; series without a seal are kept whole."""
    joined = df.join(seals.select(*keys, "holdout_start"), list(keys), "left")
    return joined.filter(F.col("holdout_start").isNull() | (F.col(order) < F.col("holdout_start"))).drop("holdout_start")


def verify_seal(df: DataFrame, seals: DataFrame, fraction: float = DEFAULT_FRACTION, layout: Layout | None = None) -> DataFrame:
    """Whether the bars before each holdout still have the digest taken when sealing."""
    keys = list((layout or Layout()).keys)
    now = fingerprint(research_window(df, seals, keys), fraction, layout).withColumnRenamed("fingerprint", "_now")
    return seals.join(now, keys, "left").select(*keys, F.coalesce(F.col("_now") == F.col("fingerprint"), F.lit(False)).alias("intact"))


def _with_bounds(df: DataFrame, bounds: DataFrame, rules: Sequence[Rule], costs: Costs, layout: Layout) -> DataFrame:
    return fills(df, costs, rules, layout).join(bounds, list(layout.keys))


def read_holdout(df: DataFrame, seals: DataFrame, rules: Sequence[Rule], ppy: DataFrame, costs: Costs = Costs(), layout: Layout | None = None) -> DataFrame:
    """Frozen rules on the sealed window; earlier bars warm the indicators, later ones are not used."""
    layout = layout or plan_layout(df)
    keys, order = list(layout.keys), layout.order
    history = df.join(seals.select(*keys, F.col("holdout_end").alias("_end")), keys).filter(F.col(order) <= F.col("_end")).drop("_end")
    bounds = seals.select(*keys, F.col("research_bars").alias("_first"))
    rows = _with_bounds(history, bounds, rules, costs, layout)
    return window_summary(rows, keys, order, ppy, F.col("_first"), F.col("_n"))


def forward_result(df: DataFrame, starts: DataFrame, rules: Sequence[Rule], ppy: DataFrame, costs: Costs = Costs(), layout: Layout | None = None) -> DataFrame:
    """Frozen rules on the bars after ``forward_start`` of each series; none yet means ``waiting``."""
    layout = layout or plan_layout(df)
    keys, order = list(layout.keys), layout.order
    joined = df.join(starts.select(*keys, "forward_start"), keys)
    bounds = joined.groupBy(*keys).agg(
        F.count_if(F.col(order) <= F.col("forward_start")).alias("_first"), F.count_if(F.col(order) > F.col("forward_start")).alias("bars"), F.max(order).alias("end")
    )
    rows = _with_bounds(df, bounds.select(*keys, "_first"), rules, costs, layout)
    figures = window_summary(rows, keys, order, ppy, F.col("_first"), F.col("_n"))
    return bounds.select(*keys, "bars", (F.col("bars") == 0).alias("waiting")).join(figures, keys, "left")
