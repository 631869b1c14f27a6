"""Indicator registry: definitions, parameter rules and the series-key grammar."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

CATEGORIES = ("Trend", "Momentum", "Volatility", "Volume", "Statistics", "Price")


@dataclass(frozen=True)
class Param:
    key: str
    default: float
    low: float
    high: float
    step: float
    integer: bool


@dataclass(frozen=True)
class Indicator:
    id: str
    name: str
    category: str
    pane: str
    outputs: tuple[str, ...]
    params: tuple[Param, ...]
    guides: tuple[float, ...]
    build: Callable


_REGISTRY: dict[str, Indicator] = {}


def indicator(name: str, category: str, pane: str = "separate", outputs=("value",), guides=(), **params):
    """Register a builder ``fn(series, **params) -> list of references``, one per output.

    A parameter is ``(default, low, high)`` for a whole number or ``(default, low, high, step)``.
    """

    def register(fn):
        specs = tuple(
            Param(key, spec[0], spec[1], spec[2], spec[3] if len(spec) > 3 else 1, len(spec) == 3)
            for key, spec in params.items()
        )
        ident = fn.__name__.rstrip("_")
        _REGISTRY[ident] = Indicator(ident, name, category, pane, tuple(outputs), specs, tuple(guides), fn)
        return fn

    return register


def _load() -> None:
    # Importing the definition modules registers them; repeated imports are free.
    from barloom.operators import ind_momentum, ind_price, ind_trend, ind_volume  # noqa: F401


def get(ident: str) -> Indicator | None:
    _load()
    return _REGISTRY.get(ident)


def all_indicators() -> list[Indicator]:
    _load()
    return sorted(_REGISTRY.values(), key=lambda d: CATEGORIES.index(d.category))


def _number(raw) -> float:
    if isinstance(raw, bool):
        return math.nan
    if isinstance(raw, (int, float)):
        return float(raw)
    try:
        return float(raw) if isinstance(raw, str) and raw.strip() else math.nan
    except ValueError:
        return math.nan


def resolve(definition: Indicator, given: Mapping[str, object] | None = None) -> dict[str, float]:
    """Fill defaults, clamp into range, round whole-number parameters; unknown names are dropped."""
    result: dict[str, float] = {}
    for spec in definition.params:
        value = _number((given or {}).get(spec.key))
        value = spec.default if math.isnan(value) else min(spec.high, max(spec.low, value))
        result[spec.key] = int(math.floor(value + 0.5)) if spec.integer else float(value)
    return result


def _text(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def instance_key(ident: str, given: Mapping[str, object] | None = None) -> str:
    """Canonical form such as ``macd(fast=12,signal=9,slow=26)``."""
    definition = get(ident)
    if definition:
        params = resolve(definition, given)
    else:
        params = {k: _number(v) for k, v in (given or {}).items() if math.isfinite(_number(v))}
    return f"{ident}({','.join(f'{k}={_text(params[k])}' for k in sorted(params))})"


def series_key(ident: str, given: Mapping[str, object] | None, output: str) -> str:
    return f"{instance_key(ident, given)}.{output}"


KEY_FORM = re.compile(r"^([a-z0-9_]+)\((.*)\)\.([A-Za-z0-9_]+)$")


def parse_key(key: str) -> tuple[Indicator, dict[str, float], str] | None:
    """Read a canonical series key; None for anything else (also for non-canonical spellings)."""
    match = KEY_FORM.match(key)
    definition = get(match.group(1)) if match else None
    if definition is None or match.group(3) not in definition.outputs:
        return None
    given = {}
    for pair in filter(str.strip, match.group(2).split(",")):
        name, _, value = pair.partition("=")
        given[name.strip()] = value
    return (definition, resolve(definition, given), match.group(3)) if series_key(definition.id, given, match.group(3)) == key else None


def catalogue() -> list[dict[str, str]]:
    """Every output of every indicator at default parameters."""
    return [
        {"id": d.id, "name": d.name, "category": d.category, "output": o, "key": series_key(d.id, None, o), "pane": d.pane}
        for d in all_indicators()
        for o in d.outputs
    ]
