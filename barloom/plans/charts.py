"""Which chart sections a series supports, with the reason where it does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.aggregates import DAY, MIN_INTRADAY_BARS, MIN_RETURNS, bar_interval
from barloom.operators.layout import Layout


def _short(have: Column, need: int, what: str) -> Column:
    return F.concat(have.cast("string"), F.lit(f" of {need} {what}"))


def _intraday_reason(interval: Column, have: Column, need: int, what: str) -> Column:
    coarse = F.concat(F.lit("one bar in "), F.round(interval, 0).cast("long").cast("string"), F.lit(" s is too coarse"))
    return F.when(interval >= DAY, coarse).otherwise(_short(have, need, what))


def chart_sections(df: DataFrame, window: int = 30, layout: Layout | None = None) -> DataFrame:
    """(series, section, available, reason) for every chart; the data comes from ``aggregates``.

    ``returns`` counts one less than the bars, as the reasons count it.
    """
    keys = list((layout or Layout()).keys)
    facts = bar_interval(df, layout)
    bars, interval, intraday = F.col("bars"), F.col("interval_seconds"), F.col("intraday")
    returns, valid = F.greatest(bars - 1, F.lit(0)), F.col("returns")
    sections = {
        "volume_profile": (F.lit(True), F.lit(None).cast("string")),
        "return_distribution": (valid >= MIN_RETURNS, _short(returns, MIN_RETURNS, "returns")),
        "drawdown": (bars >= 2, _short(bars, 2, "bars")),
        "rolling_volatility": (bars - 1 > window, _short(returns, window + 1, "returns")),
        "activity": (intraday & (bars >= MIN_INTRADAY_BARS), _intraday_reason(interval, bars, MIN_INTRADAY_BARS, "bars")),
        "seasonality.by_weekday": (valid >= MIN_RETURNS, _short(returns, MIN_RETURNS, "returns")),
        "seasonality.by_hour": (intraday & (valid >= MIN_INTRADAY_BARS), _intraday_reason(interval, returns, MIN_INTRADAY_BARS, "returns")),
    }
    cells = F.array(*(F.struct(F.lit(n).alias("section"), ok.alias("available"), F.when(~ok, why).alias("reason")) for n, (ok, why) in sections.items()))
    return facts.select(*keys, "bars", "interval_seconds", "intraday", F.explode(cells).alias("c")).select(*keys, "bars", "interval_seconds", "intraday", "c.*")
