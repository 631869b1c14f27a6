"""Per-series reports: quality, distribution, drawdown, heatmaps, seasonality, profiles, correlation.

Each returns one row per series or one row per series and cell. Row-level inputs (returns, running
peaks) come from ``Series`` so a long key is cut into blocks; what is grouped afterwards combines on
the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.statistics import norm_cdf
from barloom.operators.binning import bin_of, edge, price_bounds
from barloom.operators.indicators import references
from barloom.operators.layout import Layout, plan_layout
from barloom.operators.quantiles import key_quantiles
from barloom.operators.ranking import global_rank
from barloom.operators.series import Series
from barloom.schema import ORDER
from barloom.session import cut_lineage

DAY = 86_400
MIN_RETURNS = 30
MIN_INTRADAY_BARS = 48
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _keys(layout: Layout | None) -> list[str]:
    return list((layout or Layout()).keys)


def with_returns(df: DataFrame, layout: Layout | None = None) -> tuple[DataFrame, Layout]:
    """Bars with ``ret`` (close-to-close, percent) and ``spacing`` (seconds since the previous bar)."""
    s = Series(df, layout)
    s.output("ret", 100 * s.change(s.close))
    seconds = s.row("sec", lambda t: t.cast("timestamp").cast("double"), s.column(s.layout.order))
    s.output("spacing", s.diff(seconds))
    return s.build(), s.layout


def bar_interval(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Median bar spacing in seconds, and whether the series is intraday."""
    rows, layout = with_returns(df, layout)
    keys = list(layout.keys)
    middle = key_quantiles(rows, keys, "spacing", {"interval_seconds": 0.5}, not layout.cut)
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("bars"), F.count("ret").alias("returns"))
        .join(middle, keys, "left")
        .withColumn("intraday", F.coalesce(F.col("interval_seconds") < DAY, F.lit(False)))
    )


def quality_gaps(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Bars that come more than 1.5 times the median spacing after the previous bar."""
    rows, layout = with_returns(df, layout)
    keys = list(layout.keys)
    middle = key_quantiles(rows, keys, "spacing", {"_median": 0.5}, not layout.cut)
    wide = rows.join(middle, keys).filter((F.col("_median") > 0) & (F.col("spacing") > F.col("_median") * 1.5))
    return wide.select(*keys, F.col(layout.order).alias("after"), F.round("spacing", 3).alias("seconds"))


def quality_report(df: DataFrame, counts: DataFrame | None = None, layout: Layout | None = None) -> DataFrame:
    """Rows, time range, cadence and gaps per series.

    ``counts`` is the loader's per-series table of input, dropped and duplicate rows.
    """
    layout = layout or plan_layout(df)
    keys = list(layout.keys)
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("valid_rows"), F.min(layout.order).alias("start"), F.max(layout.order).alias("end"))
    spacing = bar_interval(df, layout).select(*keys, F.round("interval_seconds", 8).alias("median_interval_seconds"))
    gaps = quality_gaps(df, layout).groupBy(*keys).agg(F.count(F.lit(1)).alias("gaps"), F.max("seconds").alias("longest_gap_seconds"))
    report = base.join(spacing, keys, "left").join(gaps, keys, "left").fillna(0, ["gaps"])
    return report if counts is None else report.join(counts, keys, "left")


def market_report(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Latest bar, performance, indicator snapshot and signals of each series."""
    s = Series(df, layout)
    keys = list(s.layout.keys)
    lines, bands = references(s, "macd"), references(s, "bollinger")
    values = {
        "sma_20": references(s, "sma")["value"], "ema_20": references(s, "ema")["value"], "rsi_14": references(s, "rsi")["value"],
        "macd": lines["macd"], "macd_signal": lines["signal"], "atr_14": references(s, "atr")["value"],
        "vwap": references(s, "vwap")["value"], "bollinger_upper": bands["upper"], "bollinger_lower": bands["lower"],
        "support_20": s.window("low20", lambda c, l: F.min(c).over(l.rows(-19)), s.low, 19),
        "resistance_20": s.window("high20", lambda c, l: F.max(c).over(l.rows(-19)), s.high, 19),
    }
    for name, ref in values.items():
        s.output(name, ref)
    order = s.layout.order
    picked = F.struct(F.col(order).alias("time"), "open", "high", "low", "close", "volume", *values)
    last = s.build().groupBy(*keys).agg(F.max_by(picked, order).alias("x"), F.min_by("close", order).alias("_first"))
    flat = last.select(*keys, "x.*", "_first")
    r = lambda c: F.round(c, 8)
    return flat.select(
        *keys, "time", *(r(c).alias(c) for c in ("open", "high", "low", "close", "volume")),
        r((F.col("close") / F.col("_first") - 1) * 100).alias("period_return_pct"),
        r((F.col("high") - F.col("low")) / F.col("open") * 100).alias("range_pct"),
        *(r(c).alias(c) for c in values),
        r(F.col("atr_14") / F.col("close") * 100).alias("atr_pct"),
        F.when(F.col("rsi_14").isNull(), "unavailable").when(F.col("rsi_14") >= 70, "overbought").when(F.col("rsi_14") <= 30, "oversold").otherwise("neutral").alias("rsi_signal"),
        F.when(F.col("macd").isNull() | F.col("macd_signal").isNull(), "unavailable").when(F.col("macd") >= F.col("macd_signal"), "bullish").otherwise("bearish").alias("macd_signal_label"),
        F.when(F.col("ema_20").isNull(), "unavailable").when(F.col("close") >= F.col("ema_20"), "above_ema_20").otherwise("below_ema_20").alias("ema_trend"),
    )


# --- distribution ------------------------------------------------------------------------------


def _moments(value: str) -> list[Column]:
    n = F.count(value)
    skew = F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.kurtosis(value) + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return [
        n.alias("count"), F.avg(value).alias("mean_pct"), F.stddev_samp(value).alias("std_pct"), skew.alias("skew"), kurt.alias("excess_kurtosis"),
        F.min(value).alias("min_pct"), F.max(value).alias("max_pct"), (F.avg((F.col(value) > 0).cast("double")) * 100).alias("positive_pct"),
    ]


def _return_stats(df: DataFrame, layout: Layout | None):
    rows, layout = with_returns(df, layout)
    keys = list(layout.keys)
    rows = rows.filter(F.col("ret").isNotNull()).select(*keys, "ret")
    stats = rows.groupBy(*keys).agg(*_moments("ret")).filter(F.col("count") >= MIN_RETURNS)
    cuts = key_quantiles(rows, keys, "ret", {"_lo": 0.005, "_hi": 0.995, "var_95_pct": 0.05}, not layout.cut)
    wide = (F.col("_hi") <= F.col("_lo"))
    stats = stats.join(cuts, keys).select(
        *stats.columns, "var_95_pct", F.when(wide, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("low"),
        F.when(wide, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("high"),
    )
    return rows, stats, keys


def return_distribution(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Moments, tail risk and out-of-range counts of the returns (%) of each series with 30 or more."""
    rows, stats, keys = _return_stats(df, layout)
    tails = rows.join(stats.select(*keys, "low", "high", "var_95_pct"), keys).groupBy(*keys).agg(
        F.avg(F.when(F.col("ret") <= F.col("var_95_pct"), F.col("ret"))).alias("cvar_95_pct"),
        F.count_if(F.col("ret") < F.col("low")).alias("below"),
        F.count_if(F.col("ret") > F.col("high")).alias("above"),
    )
    return stats.join(tails, keys)


def return_bins(df: DataFrame, bins: int = 41, layout: Layout | None = None) -> DataFrame:
    """Histogram between the 0.5th and 99.5th percentile, with the count a fitted normal expects."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    rows, stats, keys = _return_stats(df, layout)
    low, high = F.col("low"), F.col("high")
    counted = (
        rows.join(stats.select(*keys, "low", "high"), keys)
        .filter(F.col("ret").between(low, high))
        .groupBy(*keys, bin_of(F.col("ret"), low, high, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    left, right = edge(F.col("bin"), low, high, bins), edge(F.col("bin") + 1, low, high, bins)
    step = lambda x: F.when(F.col("std_pct") > 0, norm_cdf((x - F.col("mean_pct")) / F.col("std_pct"))).otherwise((x >= F.col("mean_pct")).cast("double"))
    return grid.join(counted, [*keys, "bin"], "left").select(
        *keys, "bin", left.alias("edge_low"), right.alias("edge_high"), F.coalesce("n", F.lit(0)).alias("n"),
        (F.col("count") * (step(right) - step(left))).alias("normal"),
    )


def return_histogram(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Histogram over the whole range with min(50, max(10, n // 2)) bins."""
    rows, layout = with_returns(df, layout)
    keys = list(layout.keys)
    rows = rows.filter(F.col("ret").isNotNull()).select(*keys, "ret")
    span = rows.groupBy(*keys).agg(F.min("ret").alias("_lo"), F.max("ret").alias("_hi"), F.count("ret").alias("_n"))
    flat = F.col("_lo") == F.col("_hi")
    span = span.select(
        *keys, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("low"), F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("high"),
        F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.col("_n") / 2))).cast("int").alias("bins"),
    )
    low, high, bins = F.col("low"), F.col("high"), F.col("bins")
    counted = rows.join(span, keys).groupBy(*keys, bin_of(F.col("ret"), low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.select("*", F.explode(F.sequence(F.lit(0), bins - 1)).alias("bin"))
    return grid.join(counted, [*keys, "bin"], "left").select(
        *keys, "bin", edge(F.col("bin"), low, high, bins).alias("edge_low"), F.coalesce("n", F.lit(0)).alias("n")
    )


# --- drawdown and volatility -------------------------------------------------------------------


def underwater(df: DataFrame, layout: Layout | None = None) -> tuple[DataFrame, Layout]:
    """Bars with the running peak, the percent below it and the rows since the last peak."""
    s = Series(df, layout)
    peak = s.running("max", s.close)
    below = s.pct(s.close, peak)
    index = s.running("count", s.close)
    last_top = s.hold(s.row("top", lambda d, i: F.when(d >= 0, i), below, index))
    s.output("peak", peak)
    s.output("drawdown_pct", below)
    s.output("underwater_bars", index - last_top)
    return s.build(), s.layout


def drawdown_report(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Deepest drawdown (first trough, last bar at its peak, first recovery), current one, longest run."""
    rows, layout = underwater(df, layout)
    keys, order = list(layout.keys), layout.order
    deepest = rows.groupBy(*keys).agg(
        F.count("close").alias("_n"),
        F.min(F.struct(F.col("drawdown_pct").alias("dd"), F.col(order).alias("at"), F.col("peak").alias("peak"))).alias("t"),
        F.max_by("drawdown_pct", order).alias("current_drawdown_pct"),
        F.max("underwater_bars").cast("long").alias("longest_underwater_bars"),
    ).filter(F.col("_n") >= 2)
    joined = rows.select(*keys, order, "close").join(deepest.select(*keys, "t"), keys)
    marks = joined.groupBy(*keys).agg(
        F.max(F.when((F.col(order) <= F.col("t.at")) & (F.col("close") == F.col("t.peak")), F.col(order))).alias("peak_time"),
        F.min(F.when((F.col("t.dd") < 0) & (F.col(order) > F.col("t.at")) & (F.col("close") >= F.col("t.peak")), F.col(order))).alias("recovered_time"),
    )
    return deepest.join(marks, keys).select(
        *keys, F.col("t.dd").alias("max_drawdown_pct"), "peak_time", F.col("t.at").alias("trough_time"), "recovered_time",
        "current_drawdown_pct", "longest_underwater_bars",
    )


def rolling_volatility(df: DataFrame, window: int = 30, layout: Layout | None = None) -> DataFrame:
    """Rolling sample deviation of returns (%), for series with more than ``window`` returns."""
    if window < 2:
        raise ValueError("window must be at least 2")
    s = Series(df, layout)
    s.output("value_pct", s.std(100 * s.change(s.close), window, 1))
    keys = list(s.layout.keys)
    long_enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") - 1 > window).select(*keys)
    return s.build().join(long_enough, keys, "left_semi").select(*keys, s.layout.order, "value_pct")


# --- calendars ---------------------------------------------------------------------------------


def activity_heatmap(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Mean volume, range % and return % per UTC weekday (0 = Monday) and hour, all 168 cells."""
    layout = layout or plan_layout(df)
    rows, _ = with_returns(df, layout)
    keys, ts = list(layout.keys), F.col(layout.order)
    fit = bar_interval(df, layout).filter(F.col("intraday") & (F.col("bars") >= MIN_INTRADAY_BARS)).select(*keys)
    cells = rows.groupBy(*keys, F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(
        F.avg("volume").alias("volume"),
        F.avg(F.try_divide((F.col("high") - F.col("low")) * 100, F.col("open"))).alias("range_pct"),
        F.avg("ret").alias("return_pct"),
        F.count(F.lit(1)).alias("bars"),
    )
    grid = fit.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(167))).alias("_cell")).select(
        *keys, F.floor(F.col("_cell") / 24).cast("int").alias("weekday"), (F.col("_cell") % 24).alias("hour")
    )
    return grid.join(cells, [*keys, "weekday", "hour"], "left").fillna(0, ["bars"])


def seasonality(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Mean return, hit rate and count by UTC weekday, and by hour for intraday series."""
    layout = layout or plan_layout(df)
    rows, _ = with_returns(df, layout)
    keys, ts = list(layout.keys), F.col(layout.order)
    fit = bar_interval(df, layout)
    slots = F.array(
        F.struct(F.lit("weekday").alias("block"), F.weekday(ts).alias("slot")), F.struct(F.lit("hour").alias("block"), F.hour(ts).alias("slot"))
    )
    cells = (
        rows.filter(F.col("ret").isNotNull())
        .select(*keys, "ret", F.explode(slots).alias("c"))
        .groupBy(*keys, "c.block", "c.slot")
        .agg(F.avg("ret").alias("mean_return_pct"), (F.avg((F.col("ret") > 0).cast("double")) * 100).alias("hit_rate_pct"), F.count(F.lit(1)).alias("n"))
    )
    days = F.when(F.col("returns") >= MIN_RETURNS, F.sequence(F.lit(0), F.lit(6)))
    hours = F.when(F.col("intraday") & (F.col("returns") >= MIN_INTRADAY_BARS), F.sequence(F.lit(0), F.lit(23)))
    grid = fit.select(*keys, F.lit("weekday").alias("block"), F.explode(days).alias("slot")).unionByName(
        fit.select(*keys, F.lit("hour").alias("block"), F.explode(hours).alias("slot"))
    )
    labels = F.array(*(F.lit(d) for d in WEEKDAYS))
    return grid.join(cells, [*keys, "block", "slot"], "left").fillna(0, ["n"]).withColumn(
        "label", F.when(F.col("block") == "weekday", F.element_at(labels, F.col("slot") + 1)).otherwise(F.lpad(F.col("slot").cast("string"), 2, "0"))
    )


def time_grid(df: DataFrame, zone: str = "Asia/Kolkata", layout: Layout | None = None) -> DataFrame:
    """Total volume and mean range % per hour and 5-minute slot of the capture zone; empty cells are 0."""
    keys = _keys(layout)
    local = F.from_utc_timestamp(F.col((layout or Layout()).order), zone)
    cells = df.groupBy(*keys, F.hour(local).alias("hour"), (F.floor(F.minute(local) / 5) * 5).cast("int").alias("slot")).agg(
        F.sum("volume").alias("volume"), F.avg(F.try_divide((F.col("high") - F.col("low")) * 100, F.col("open"))).alias("range_pct")
    )
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(287))).alias("_cell")).select(
        *keys, F.floor(F.col("_cell") / 12).cast("int").alias("hour"), ((F.col("_cell") % 12) * 5).alias("slot")
    )
    return grid.join(cells, [*keys, "hour", "slot"], "left").fillna(0.0, ["volume", "range_pct"])


# --- price profiles ----------------------------------------------------------------------------


def profile_bins(df: DataFrame, bins: int = 60, layout: Layout | None = None) -> DataFrame:
    """Volume per price bin: each bar's volume spread over the bins its range overlaps.

    A bar meets only the bins between its low and high (at most ``bins``), so this is a generated
    sequence and an aggregation rather than a range join.
    """
    if bins < 2:
        raise ValueError("bins must be at least 2")
    keys = _keys(layout)
    span = df.groupBy(*keys).agg(F.min("low").alias("_l"), F.max("high").alias("_h"))
    low, high = price_bounds(F.col("_l"), F.col("_h"))
    span = span.select(*keys, low.alias("p_low"), high.alias("p_high"))
    lo, hi = F.col("p_low"), F.col("p_high")
    spread = (
        df.join(span, keys)
        .withColumn("_from", bin_of(F.col("low"), lo, hi, bins))
        .withColumn("_to", bin_of(F.col("high"), lo, hi, bins))
        .withColumn("_flat", F.col("high") <= F.col("low"))
        .withColumn("bin", F.explode(F.when(F.col("_flat"), F.array("_to")).otherwise(F.sequence("_from", "_to"))))
    )
    overlap = F.least(F.col("high"), edge(F.col("bin") + 1, lo, hi, bins)) - F.greatest(F.col("low"), edge(F.col("bin"), lo, hi, bins))
    share = F.when(F.col("_flat"), F.col("volume")).otherwise(F.greatest(overlap, F.lit(0.0)) * F.col("volume") / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    filled = spread.groupBy(*keys, "bin").agg(F.sum(share).alias("volume"))
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(filled, [*keys, "bin"], "left").select(
        *keys, "bin", edge(F.col("bin"), lo, hi, bins).alias("edge_low"), edge(F.col("bin") + 1, lo, hi, bins).alias("edge_high"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
    )


def volume_profile(df: DataFrame, bins: int = 60, value_area: float = 0.7, layout: Layout | None = None) -> DataFrame:
    """Point of control and value area, grown from the heaviest bin towards the heavier neighbour."""
    keys = _keys(layout)
    cells = F.array_sort(F.collect_list(F.struct("bin", "volume", "edge_low", "edge_high")))
    packed = profile_bins(df, bins, layout).groupBy(*keys).agg(cells.alias("b"), F.sum("volume").alias("total_volume"))
    volumes = F.col("b.volume")
    packed = packed.withColumn("_poc", F.array_position(volumes, F.array_max(volumes)).cast("int"))
    at = lambda i: F.coalesce(F.try_element_at(volumes, i), F.lit(-1.0))
    start = F.struct(F.col("_poc").alias("lo"), F.col("_poc").alias("hi"), at(F.col("_poc")).alias("covered"))

    def grow(acc, _):
        down = F.when(acc["lo"] > 1, at(acc["lo"] - 1)).otherwise(F.lit(-1.0))
        up = F.when(acc["hi"] < bins, at(acc["hi"] + 1)).otherwise(F.lit(-1.0))
        going = (acc["covered"] < F.col("total_volume") * value_area) & ((acc["lo"] > 1) | (acc["hi"] < bins))
        rises = going & (up >= down)
        falls = going & (up < down)
        return F.struct(
            F.when(falls, acc["lo"] - 1).otherwise(acc["lo"]).alias("lo"),
            F.when(rises, acc["hi"] + 1).otherwise(acc["hi"]).alias("hi"),
            (acc["covered"] + F.when(rises, up).when(falls, down).otherwise(F.lit(0.0))).alias("covered"),
        )

    area = F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, grow)
    return packed.withColumn("_area", area).select(
        *keys, "total_volume",
        ((F.element_at("b", F.col("_poc"))["edge_low"] + F.element_at("b", F.col("_poc"))["edge_high"]) / 2).alias("poc"),
        F.element_at("b", F.col("_area.lo"))["edge_low"].alias("value_low"),
        F.element_at("b", F.col("_area.hi"))["edge_high"].alias("value_high"),
    )


def price_time_density(df: DataFrame, price_bins: int = 80, layout: Layout | None = None) -> DataFrame:
    """Volume by bar and mid-price bin: one time column per bar, empty cells left out."""
    s = Series(df, layout)
    s.output("bar", s.running("count", s.row("one", lambda c: F.lit(1.0), s.close)) - 1)
    keys = list(s.layout.keys)
    span = df.groupBy(*keys).agg(F.min("low").alias("_l"), F.max("high").alias("_h"))
    low, high = price_bounds(F.col("_l"), F.col("_h"))
    rows = s.build().join(span.select(*keys, low.alias("p_low"), high.alias("p_high")), keys)
    cell = bin_of((F.col("high") + F.col("low")) / 2, F.col("p_low"), F.col("p_high"), price_bins)
    return rows.groupBy(*keys, F.col("bar").cast("long").alias("bar"), cell.alias("price_bin")).agg(F.sum("volume").alias("volume"))


# --- across series -----------------------------------------------------------------------------


def shared_timestamps(df: DataFrame, labels: Sequence[str], order: str = ORDER) -> DataFrame:
    """Timestamps on which every labelled series has a bar."""
    wanted = df.filter(F.col("symbol").isin(list(labels)) & F.col("close").isNotNull())
    return wanted.groupBy(order).agg(F.count_distinct("symbol").alias("_n")).filter(F.col("_n") == len(set(labels))).select(order)


def correlation_matrix(df: DataFrame, labels: Sequence[str] | DataFrame, layout: Layout | None = None, tile: int = 128, rows: int = 2048) -> DataFrame:
    """Pearson correlation of returns over the timestamps all labelled series share, as (a, b, corr).

    ``labels`` may be a table with a column ``symbol``, for thousands of series. Up to ``tile`` listed labels are one block;
    more of them, and those of a table, are numbered and cut into blocks of ``tile``.
    """
    if not isinstance(labels, DataFrame):
        listed = list(dict.fromkeys(labels))
        if len(listed) <= tile:
            return _correlation_one_block(df, listed, layout)
        names = df.sparkSession.createDataFrame(list(zip(listed, range(len(listed)))), "symbol string, _i int")
        return _correlation_tiles(df, names, len(listed), layout, tile, rows)
    named = labels.select("symbol").filter(F.col("symbol").isNotNull()).distinct()
    names = global_rank(named, [F.col("symbol")], "_i").withColumn("_i", (F.col("_i") - 1).cast("int"))
    return _correlation_tiles(df, names, names.count(), layout, tile, rows)


def _correlation_one_block(df: DataFrame, labels: Sequence[str], layout: Layout | None) -> DataFrame:
    """The matrix of few series: each task reduces its rows to one matrix of cross products, and only those are shuffled."""
    names = list(dict.fromkeys(labels))
    common = df.join(shared_timestamps(df, names), ORDER).filter(F.col("symbol").isin(names))
    s = Series(common, layout)
    s.output("ret", s.change(s.close))
    rows = s.build().filter(F.col("ret").isNotNull()).select("symbol", s.layout.order, "ret")
    center = rows.groupBy("symbol").agg(F.avg("ret").alias("_m"))
    packed = (
        rows.join(center, "symbol")
        .groupBy(s.layout.order)
        .agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.col("ret") - F.col("_m")))).alias("_x"))
        .select(s.layout.order, F.array(*(F.element_at("_x", F.lit(n)) for n in names)).alias("x"))
        .filter(F.forall("x", lambda v: v.isNotNull()))
    )
    width = len(names)

    def cross_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen, first, last = np.zeros((width, width)), 0, None, None
        for batch in batches:
            if len(batch):
                x = np.vstack(batch["x"].to_numpy())
                total += x.T @ x
                seen += len(batch)
                lo, hi = batch[order].min(), batch[order].max()
                first, last = lo if first is None else min(first, lo), hi if last is None else max(last, hi)
        if seen:
            i, j = np.indices((width, width))
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "p": total.ravel(), "n": seen, "lo": first, "hi": last})

    order = s.layout.order
    sums = packed.mapInPandas(cross_products, "i int, j int, p double, n long, lo timestamp, hi timestamp").groupBy("i", "j").agg(
        F.sum("p").alias("p"), F.sum("n").alias("observations"), F.min("lo").alias("start"), F.max("hi").alias("end")
    ).filter(F.col("observations") >= 3)
    diagonal = sums.filter(F.col("i") == F.col("j"))
    table = F.array(*(F.lit(n) for n in names))
    return (
        sums.join(diagonal.select("i", F.col("p").alias("_pi")), "i")
        .join(diagonal.select(F.col("j"), F.col("p").alias("_pj")), "j")
        .select(
            F.element_at(table, F.col("i") + 1).alias("a"), F.element_at(table, F.col("j") + 1).alias("b"),
            F.try_divide(F.col("p"), F.sqrt(F.col("_pi") * F.col("_pj"))).alias("corr"), "observations", "start", "end",
        )
    )


def _correlation_tiles(df: DataFrame, names: DataFrame, width: int, layout: Layout | None, tile: int, rows: int) -> DataFrame:
    """The matrix of many series. The shared timestamps are cut into runs of ``rows``; a task multiplies two blocks of labels
    over one run, so it holds two matrices and a strip of their product. A block has ``tile`` labels, and a matrix ``rows``
    times ``tile`` cells at most; where there is one run, it has up to 1/24 of the labels and ``CELLS`` cells. Single
    pairs are never shuffled: products are summed block by block, and only if there are several runs."""
    shape = layout or Layout()
    order = shape.order
    source = df.select(*dict.fromkeys((*shape.keys, "symbol", order, "close")))
    bars = cut_lineage(source.filter(F.col("close").isNotNull()).join(names, "symbol"))
    shared = bars.groupBy(order).agg(F.count_distinct("_i").alias("_n")).filter(F.col("_n") == width).select(order)
    returns = Series(bars.drop("_i").join(shared, order), layout)
    returns.output("ret", returns.change(returns.close))
    found = cut_lineage(returns.build().filter(F.col("ret").isNotNull()).select("symbol", order, "ret").join(names, "symbol"))
    kept = found.groupBy(order).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == width).select(order)
    times = global_rank(kept, [F.col(order)], "_t").withColumn("_t", (F.col("_t") - 1).cast("long"))
    span = times.agg(F.count(F.lit(1)).alias("observations"), F.min(order).alias("start"), F.max(order).alias("end")).filter(F.col("observations") >= 3)
    observations = span.select("observations").first()
    if observations is None:
        return names.select(F.col("symbol").alias("a"), F.col("symbol").alias("b"), F.lit(None).cast("double").alias("corr")).crossJoin(span)
    # A block goes to as many tasks as there are blocks: few timestamps make room for higher ones, whatever the number of labels.
    if observations[0] <= rows:
        tile = max(tile, min(CELLS // observations[0], width // 24))
    center = found.join(kept, order).groupBy("_i").agg(F.avg("ret").alias("_m"))
    cells = found.join(times, order).join(center, "_i").withColumn("x", F.col("ret") - F.col("_m"))
    block = F.floor(F.col("_i") / tile).cast("int").alias("block")
    listed = (
        cells.groupBy("_i").agg(F.sum(F.col("x") * F.col("x")).alias("square")).join(names, "_i").groupBy(block)
        .agg(F.array_sort(F.collect_list(F.struct("_i", "symbol", "square"))).alias("l")).select("block", F.col("l.symbol").alias("label"), F.col("l.square").alias("square"))
    )
    blocks = (
        cells.groupBy(F.floor(F.col("_t") / rows).alias("run"), block)
        .agg(F.array_sort(F.collect_list(F.struct("_i", "_t", "x"))).alias("x")).select("run", "block", F.col("x.x").alias("x")).join(listed, "block")
    )
    # Each block meets those after it; the pairs the other way round are the same figures.
    left = blocks.withColumn("other", F.explode(F.sequence("block", F.lit((width - 1) // tile))))
    right = blocks.select("run", F.col("block").alias("other"), F.col("x").alias("y"), F.col("label").alias("label_b"), F.col("square").alias("square_b")).withColumn("block", F.explode(F.sequence(F.lit(0), "other")))
    # The work grows with the square of the labels, which bytes don't tell: a partition for each pair, left as it is.
    high, runs = -(-width // tile), -(-observations[0] // rows)
    dealt = min(high * (high + 1) // 2 * runs, MOST_PARTS), "block", "other", "run"
    pairs = left.repartition(*dealt).join(right.repartition(*dealt).hint("merge"), ["block", "other", "run"])
    if observations[0] <= rows:
        chunks = pairs.groupBy("block", "other", "run").applyInArrow(_correlated, CHUNK)
    else:
        parts = pairs.groupBy("block", "other", "run").applyInArrow(_partial, PARTIAL)
        chunks = parts.groupBy("block", "other").applyInArrow(_summed, CHUNK)
    return chunks.crossJoin(F.broadcast(span)).select(F.inline(F.arrays_zip("a", "corr")), "b", "observations", "start", "end").select(
        "a", F.inline(F.arrays_zip("b", "corr")), "observations", "start", "end"
    )


#: Cells of a block over one run and of a strip of products; cells of a chunk of the result.
CELLS, CHUNK_CELLS = 1 << 20, 1 << 16
MOST_PARTS = 2_000
PARTIAL = "block int, other int, label array<string>, square array<double>, label_b array<string>, square_b array<double>, p array<double>"
CHUNK = "a array<string>, b array<string>, corr array<array<double>>"


def _numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """The numbers of a list in the first row."""
    return table.column(name)[0].values.to_numpy(zero_copy_only=False)


def _matrices(pair: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Two blocks over one run, a row for each label."""
    x, y = (_numbers(pair, c).reshape(len(pair.column(label)[0]), -1) for c, label in (("x", "label"), ("y", "label_b")))
    return x, y


def _correlated(pair: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The correlations of two blocks over the only run."""
    for batch in pair:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            x, y = _matrices(one)
            yield from _chunks(one, lambda some: x[some] @ y.T)


def _partial(pair: pa.Table) -> pa.Table:
    """Cross products of two blocks over one run of several."""
    x, y = _matrices(pair)
    return pair.select(["block", "other", "label", "square", "label_b", "square_b"]).append_column("p", _lists((x @ y.T).reshape(1, -1)))


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The correlations of two blocks from their products over each run; one sum is held."""
    first, total = None, None
    for batch in parts:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            p = _numbers(one, "p")
            first, total = (one, p.copy()) if first is None else (first, total + p)
    if first is not None:
        p = total.reshape(len(first.column("label")[0]), -1)
        yield from _chunks(first, lambda some: p[some])


def _lists(values: np.ndarray, empty: np.ndarray | None = None) -> pa.Array:
    """A list for each row of a matrix."""
    flat = pa.array(values.ravel(), mask=None if empty is None else empty.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), flat)


def _chunks(pair: pa.RecordBatch, products: Callable[[slice], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Correlations from the cross products of some labels of the first block at a time, in both directions unless a block meets itself."""
    square, square_b = (_numbers(pair, c) for c in ("square", "square_b"))
    names, names_b = (pair.column(c)[0].values for c in ("label", "label_b"))
    mirrored = pair.column("block")[0].as_py() != pair.column("other")[0].as_py()
    step = max(1, CELLS // len(names_b))
    for start in range(0, len(names), step):
        some = slice(start, start + step)
        with np.errstate(all="ignore"):
            size = np.sqrt(np.outer(square[some], square_b))
            corr = products(some) / size
        empty, labels = size == 0, names.slice(start, step)
        yield _folded(labels, names_b, corr, empty)
        if mirrored:
            yield _folded(names_b, labels, np.ascontiguousarray(corr.T), np.ascontiguousarray(empty.T))


def _folded(a: pa.Array, b: pa.Array, corr: np.ndarray, empty: np.ndarray) -> pa.RecordBatch:
    """Some rows of the matrix in each row of the table."""
    cuts = pa.array([*range(0, len(a), max(1, CHUNK_CELLS // len(b))), len(a)], pa.int32())
    each = len(cuts) - 1
    columns = [
        pa.ListArray.from_arrays(cuts, a), pa.ListArray.from_arrays(pa.array(np.arange(each + 1) * len(b), pa.int32()), pa.concat_arrays([b] * each)),
        pa.ListArray.from_arrays(cuts, _lists(corr, empty)),
    ]
    return pa.record_batch(columns, names=["a", "b", "corr"])


def gap_statistics(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Close-to-open gaps in basis points: mean, 99th percentile and largest."""
    s = Series(df, layout)
    s.output("gap", 10_000 * s.abs(s.open / s.lag(s.close) - 1))
    keys = list(s.layout.keys)
    rows = s.build()
    top = key_quantiles(rows, keys, "gap", {"p99_abs": 0.99}, not s.layout.cut)
    return rows.groupBy(*keys).agg(F.avg("gap").alias("mean_abs"), F.max("gap").alias("max_abs")).join(top, keys, "left")


def series_summary(df: DataFrame, value: str = "close", layout: Layout | None = None) -> DataFrame:
    """Latest, change against the previous reading, change over the period, extremes, average volume."""
    s = Series(df.filter(F.col(value).isNotNull()), layout)
    s.output("_previous", s.lag(s.column(value)))
    keys, order = list(s.layout.keys), s.layout.order
    flat = s.build().groupBy(*keys).agg(
        F.max_by(F.struct(F.col(value).alias("latest"), F.col("_previous").alias("previous")), order).alias("x"),
        F.min_by(value, order).alias("first"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.avg("volume").alias("average_volume"), F.count(value).alias("points"), F.min(order).alias("start"), F.max(order).alias("end"),
    )
    return flat.select(
        *keys, "x.latest", (F.col("x.latest") - F.col("x.previous")).alias("change"),
        F.when(F.col("points") > 1, (F.try_divide(F.col("x.latest"), F.col("first")) - 1) * 100).alias("period_pct"),
        "low", "high", "average_volume", "points", "start", "end",
    )


def extent(df: DataFrame, value: str, layout: Layout | None = None) -> DataFrame:
    return df.groupBy(*_keys(layout)).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; the key's rows combine on the map side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def grouped_counts(df: DataFrame, key: str, order: str) -> DataFrame:
    """Groups in first-seen order with their sizes."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy("first")
