"""Ready-made conditions derived from the indicator registry, and one scan over many of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import registry
from barloom.operators.filters import BarFields, compile_filter, condition
from barloom.operators.layout import Layout
from barloom.operators.series import Series

# Ids of the presets are the series' name and one of these endings.
ON_BARS = [(f"{op}:{n}", op, n) for n in (20, 55, 100) for op in ("new_high", "new_low")] + [("rising:3", "rising", 3), ("falling:3", "falling", 3)]
AGAINST_CLOSE = [("close>", "gt"), ("close<", "lt"), ("close^", "crosses_above"), ("closev", "crosses_below")]
AGAINST_GUIDES = [("gt-high", "gt", -1), ("lt-low", "lt", 0), ("x-high", "crosses_above", -1), ("x-low", "crosses_below", 0)]
ON_SERIES = [("rising", "rising", 3), ("falling", "falling", 3), ("hi20", "new_high", 20), ("lo20", "new_low", 20), ("top10", "top_pct", 10), ("bottom10", "bottom_pct", 10)]


def _of_series(key: str, pane: str, guides: list[float]) -> dict[str, dict]:
    if pane == "price":
        return {ending: condition("close", op, rhs=key) for ending, op in AGAINST_CLOSE}
    found = {ending: condition(key, op, n) for ending, op, n in ON_SERIES}
    if guides:
        found |= {ending: condition(key, op, guides[which]) for ending, op, which in AGAINST_GUIDES}
    if len(set(guides)) > 1:
        found["between"] = condition(key, "between", guides[0], guides[-1])
    return found


def preset_filters() -> dict[str, dict]:
    """Preset id -> condition: bar columns against their past, price-pane series against the close, others against their
    guides and their past."""
    presets = {f"{bar}:{ending}": condition(bar, op, n) for bar in ("close", "high", "low", "volume") for ending, op, n in ON_BARS}
    presets["volume:top10"] = condition("volume", "top_pct", 10)
    for entry in registry.catalogue():
        own = _of_series(entry["key"], entry["pane"], sorted(registry.get(entry["id"]).guides))
        presets |= {f"{entry['key']}:{ending}": leaf for ending, leaf in own.items()}
    return presets


def scan_presets(df: DataFrame, ids: Iterable[str] | None = None, layout: Layout | None = None) -> DataFrame:
    """Matches and last matching time of each preset on each series, from one pass over the bars."""
    presets = preset_filters()
    chosen = list(ids) if ids is not None else list(presets)
    s = Series(df, layout)
    for i, ident in enumerate(chosen):
        s.output(f"_p{i}", compile_filter(BarFields(s), presets[ident]).mask)
    keys, order = s.layout.keys, s.layout.order
    wide = s.build().groupBy(*keys).agg(
        *(F.count_if(f"_p{i}").alias(f"n{i}") for i in range(len(chosen))),
        *(F.max(F.when(F.col(f"_p{i}"), F.col(order))).alias(f"t{i}") for i in range(len(chosen))),
    )
    cells = F.array(*(F.struct(F.lit(p).alias("preset_id"), F.col(f"n{i}").alias("matches"), F.col(f"t{i}").alias("last_match")) for i, p in enumerate(chosen)))
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
