"""Volume indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators.ind_trend import period, typical
from barloom.operators.ind_price import close_location
from barloom.operators.registry import indicator
from barloom.operators.series import Ref, Series


def flow_total(s: Series) -> Ref:
    """Accumulation/distribution: running close location times volume."""
    flow = close_location(s) * s.volume
    return s.only_where(s.running("sum", flow), flow)


def traded(s: Series) -> tuple[Ref, Ref]:
    """Close and volume of the bars that have both."""
    return s.only_where(s.close, s.volume), s.only_where(s.volume, s.close)


def running_flow(s: Series, flow: Ref, where: Ref) -> Ref:
    total = s.row("orzero", lambda v: F.coalesce(v, F.lit(0.0)), s.running("sum", flow))
    return s.only_where(total, where)


@indicator("On-Balance Volume", "Volume")
def obv(s):
    close, volume = traded(s)
    before = s.lag(s.hold(close))
    return [running_flow(s, s.row("obv", lambda c, p, v: F.signum(c - p) * v, close, before, volume), close)]


@indicator("Accumulation/Distribution Line", "Volume")
def ad_line(s):
    return [flow_total(s)]


@indicator("Chaikin Money Flow", "Volume", guides=(0,), period=period())
def cmf(s, period):
    return [s.clamp(s.sum(close_location(s) * s.volume, period) / s.sum(s.volume, period), -1, 1)]


@indicator("Chaikin Oscillator", "Volume", guides=(0,), fast=(3, 1, 100), slow=(10, 2, 300))
def chaikin_osc(s, fast, slow):
    return [s.ema(flow_total(s), fast) - s.ema(flow_total(s), slow)]


@indicator("Money Flow Index", "Volume", guides=(20, 80), period=period(14, 2))
def mfi(s, period):
    price = typical(s)
    change, flow = s.diff(price), price * s.volume
    up = s.row("inflow", lambda d, f: F.when(d > 0, f).when(d <= 0, 0.0), change, flow)
    down = s.row("outflow", lambda d, f: F.when(d < 0, f).when(d >= 0, 0.0), change, flow)

    def ratio(u, d):
        value = F.when(d == 0, F.when(u > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + F.try_divide(u, d)))
        return F.when(u.isNotNull() & d.isNotNull(), value)

    return [s.row("mfi", ratio, s.sum(up, period), s.sum(down, period))]


@indicator("Force Index", "Volume", guides=(0,), period=period(13))
def force_index(s, period):
    return [s.ema(s.volume * s.diff(s.close), period)]


@indicator("Ease of Movement", "Volume", guides=(0,), period=period(14), scale=(1_000_000.0, 1.0, 1e12, 1.0))
def ease_of_movement(s, period, scale):
    move = s.diff((s.high + s.low) / 2)
    return [s.mean(s.when(s.volume > 0, move * (s.high - s.low) * scale / s.volume), period)]


@indicator("Volume SMA", "Volume", period=period())
def volume_sma(s, period):
    return [s.mean(s.volume, period)]


@indicator("Volume Rate of Change %", "Volume", guides=(0,), period=period(14))
def volume_roc(s, period):
    return [s.roc(s.volume, period)]


@indicator("Relative Volume", "Volume", guides=(1,), period=period())
def relative_volume(s, period):
    return [s.volume / s.mean(s.volume, period)]


@indicator("Volume Z-Score", "Volume", guides=(-2, 0, 2), window=(20, 2, 500))
def volume_zscore(s, window):
    mean, spread = s.mean(s.volume, window), s.std(s.volume, window, 1)
    return [s.when(spread > 1e-12 * s.abs(mean), (s.volume - mean) / spread)]


@indicator("Volume Oscillator %", "Volume", guides=(0,), fast=(5, 1, 100), slow=(10, 2, 300))
def volume_oscillator(s, fast, slow):
    return [s.pct(s.ema(s.volume, fast), s.ema(s.volume, slow))]


@indicator("Klinger Volume Oscillator", "Volume", outputs=("kvo", "signal"), guides=(0,), fast=(34, 1, 200), slow=(55, 2, 400), signal=(13, 1, 100))
def klinger(s, fast, slow, signal):
    total = s.only_where(s.high + s.low + s.close, s.volume)
    span = s.only_where(s.high - s.low, total)
    trend = s.row("trend", lambda d: F.when(d > 0, 1.0).when(d <= 0, -1.0), s.diff(total))
    # The measured move restarts from the previous bar's range whenever the trend turns.
    turned = s.row("turned", lambda t, p: F.when(t.isNotNull(), F.coalesce(t != p, F.lit(True))), trend, s.lag(trend))
    keep = s.when(turned, 0.0, 1.0)
    keep = s.only_where(keep, trend)
    added = s.only_where(s.when(turned, span + s.lag(span), span), trend)
    move = s.affine(keep, added)
    force = s.row(
        "force",
        lambda m, r, t, v: F.when(m == 0, 0.0).otherwise(v * F.abs(2 * (F.try_divide(r, m) - 1)) * t * 100),
        move, span, trend, s.volume,
    )
    line = s.ema(force, fast) - s.ema(force, slow)
    return [line, s.ema(line, signal)]


@indicator("Price Volume Trend", "Volume")
def pvt(s):
    close, volume = traded(s)
    before = s.lag(s.hold(close))
    return [running_flow(s, volume * (close / before - 1), close)]


def _volume_index(s: Series, start: float, falling: bool) -> Ref:
    close, volume = traded(s)
    before, earlier = s.lag(s.hold(close)), s.lag(s.hold(volume))
    moved = volume < earlier if falling else volume > earlier
    factor = s.row("follow", lambda m, r: F.when(m, r), moved, close / before)
    total = s.row("orone", lambda v: F.coalesce(v, F.lit(1.0)), s.running("product", factor))
    return s.only_where(start * total, close)


@indicator("Negative Volume Index", "Volume", start=(1000.0, 1.0, 1e6, 1.0))
def nvi(s, start):
    return [_volume_index(s, start, True)]


@indicator("Positive Volume Index", "Volume", start=(1000.0, 1.0, 1e6, 1.0))
def pvi(s, start):
    return [_volume_index(s, start, False)]


@indicator("Rolling VWAP Distance %", "Volume", guides=(0,), period=period())
def vwap_distance(s, period):
    return [s.pct(s.close, s.sum(typical(s) * s.volume, period) / s.sum(s.volume, period))]


@indicator("Dollar Volume", "Volume")
def dollar_volume(s):
    return [s.close * s.volume]
