"""Forward returns after the bars that match a filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.filters import BarFields, compile_filter, onset
from barloom.operators.layout import Layout
from barloom.operators.quantiles import key_quantiles
from barloom.operators.series import Series
from barloom.schema import finite


def event_study(
    df: DataFrame,
    tree: Mapping | None,
    horizons: Sequence[int] = (1, 5, 10, 20, 50),
    onset_only: bool = False,
    layout: Layout | None = None,
) -> DataFrame:
    """Per series and horizon: statistics of ``close[t+h]/close[t]-1`` after matches, beside all bars.

    The return is booked on the later bar (a look-back of ``h`` rows), so it needs no look-ahead frame.
    Bars too recent for a forward return count as events only.
    """
    s = Series(df, layout)
    mask = compile_filter(BarFields(s), tree).mask
    active = None if mask is None else (onset(s, mask) if onset_only else mask)
    never = s.row("never", lambda *_: F.lit(False))
    for h in horizons:
        s.output(f"_r{h}", s.row("fwd", finite, s.change(s.close, h)))
        s.output(f"_a{h}", s.lag(active, h) if active is not None else never)
    s.output("_event", active if active is not None else never)
    wide = s.build()
    keys = list(s.layout.keys)
    cells = F.array(
        *(F.struct(F.lit(h).alias("horizon"), F.col(f"_r{h}").alias("r"), F.col(f"_a{h}").alias("hit")) for h in horizons)
    )
    long = wide.select(*keys, "_event", F.explode(cells).alias("c")).select(
        *keys, "_event", "c.horizon", "c.r", F.when(F.col("c.hit"), F.col("c.r")).alias("e")
    )
    stats = long.groupBy(*keys, "horizon").agg(
        F.count_if("_event").alias("events"),
        F.count("e").alias("n"),
        F.avg(F.when(F.col("e").isNotNull(), (F.col("e") > 0).cast("double"))).alias("hit_rate"),
        F.avg("e").alias("mean"),
        F.stddev_samp("e").alias("std"),
        F.max("e").alias("best"),
        F.min("e").alias("worst"),
        F.avg("r").alias("baseline_mean"),
    )
    middle = key_quantiles(long, [*keys, "horizon"], "e", {"median": 0.5}, bounded=not s.layout.cut)
    return stats.join(middle, [*keys, "horizon"], "left").select(
        *keys, "horizon", "events", "n", "hit_rate", "mean", "median", "std", "best", "worst", "baseline_mean",
        (F.col("mean") - F.col("baseline_mean")).alias("excess_mean"),
        F.when(F.col("std") > 0, F.col("mean") / (F.col("std") / F.sqrt("n"))).alias("t_stat"),
    )
