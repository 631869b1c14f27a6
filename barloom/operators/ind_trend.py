"""Trend indicators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.operators.registry import indicator
from barloom.operators.series import Ref, Series

BANDS = ("lower", "middle", "upper")


def typical(s: Series) -> Ref:
    return (s.high + s.low + s.close) / 3


def midpoint(s: Series) -> Ref:
    return (s.high + s.low) / 2


def true_range(s: Series) -> Ref:
    """Largest of the bar range and the two gaps to the previous close; the first bar is its range."""
    previous = s.lag(s.close)
    wide = s.greatest(s.high - s.low, s.abs(s.high - previous), s.abs(s.low - previous))
    return s.row("tr", lambda first, a, b: F.when(first, a).otherwise(b), s.first_bar(), s.high - s.low, wide)


def atr_smooth(s: Series, period: int) -> Ref:
    return s.wilder(true_range(s), period)


def rising_part(s: Series, change: Ref) -> Ref:
    return s.row("up", lambda d: F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), change)


def falling_part(s: Series, change: Ref) -> Ref:
    return s.row("down", lambda d: F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), change)


def period(default=20, low=1, high=500):
    return (default, low, high)


def mult(default=2.0):
    return (default, 0.1, 10.0, 0.1)


@indicator("Simple Moving Average", "Trend", "price", period=period())
def sma(s, period):
    return [s.mean(s.close, period)]


@indicator("Exponential Moving Average", "Trend", "price", period=period())
def ema(s, period):
    return [s.ema(s.close, period)]


@indicator("Weighted Moving Average", "Trend", "price", period=period())
def wma(s, period):
    return [s.wma(s.close, period)]


@indicator("Double Exponential Moving Average", "Trend", "price", period=period())
def dema(s, period):
    first = s.ema(s.close, period)
    return [2 * first - s.ema(first, period)]


@indicator("Triple Exponential Moving Average", "Trend", "price", period=period())
def tema(s, period):
    first = s.ema(s.close, period)
    second = s.ema(first, period)
    return [3 * first - 3 * second + s.ema(second, period)]


@indicator("Hull Moving Average", "Trend", "price", period=period())
def hma(s, period):
    half = s.wma(s.close, max(1, period // 2))
    return [s.wma(2 * half - s.wma(s.close, period), max(1, math.floor(math.sqrt(period) + 0.5)))]


@indicator("Kaufman Adaptive Moving Average", "Trend", "price", period=period(10, 2), fast=(2, 1, 100), slow=(30, 2, 500))
def kama(s, period, fast, slow):
    change = s.abs(s.diff(s.close, period))
    path = s.sum(s.abs(s.diff(s.close)), period)
    quick, calm = 2 / (fast + 1), 2 / (slow + 1)
    ratio = s.row("er", lambda c, p: F.when(c.isNotNull() & (p > 0), c / p).when(c.isNotNull() & (p >= 0), 0.0), change, path)
    root = ratio * (quick - calm) + calm
    weight = root * root
    weight = s.only_where(weight, s.close)
    begins = s.running("count", weight) <= 1
    prior = s.row("prior", lambda p, c: F.coalesce(p, c), s.lag(s.close), s.close)
    step = s.row("kstep", lambda b, w: F.when(w.isNotNull(), F.when(b, 0.0).otherwise(1 - w)), begins, weight)
    offset = s.row("koff", lambda b, w, c, p: F.when(b, p + w * (c - p)).otherwise(w * c), begins, weight, s.close, prior)
    return [s.affine(step, offset)]


@indicator("Volume Weighted Moving Average", "Trend", "price", period=period())
def vwma(s, period):
    return [s.sum(s.close * s.volume, period) / s.sum(s.volume, period)]


@indicator("Zero-Lag EMA", "Trend", "price", period=period(20, 2))
def zlema(s, period):
    return [s.ema(2 * s.close - s.lag(s.close, (period - 1) // 2), period)]


@indicator("Tillson T3", "Trend", "price", period=period(5, 1, 100), vfactor=(0.7, 0.0, 1.0, 0.05))
def t3(s, period, vfactor):
    stages = [s.close]
    for _ in range(6):
        stages.append(s.ema(stages[-1], period))
    v = vfactor
    cubed, squared = v**3, v**2
    weights = {6: -cubed, 5: 3 * (squared + cubed), 4: -(6 * squared + 3 * v + 3 * cubed), 3: 1 + 3 * v + cubed + 3 * squared}
    return [weights[6] * stages[6] + weights[5] * stages[5] + weights[4] * stages[4] + weights[3] * stages[3]]


@indicator("Smoothed Moving Average", "Trend", "price", period=period(14))
def smma(s, period):
    return [s.wilder(s.close, period)]


@indicator("Triangular Moving Average", "Trend", "price", period=period())
def trima(s, period):
    first = (period + 1) // 2 if period % 2 else period // 2
    second = first if period % 2 else first + 1
    return [s.mean(s.mean(s.close, first), second)]


def _mcginley_step(period):
    def step(state, row):
        close = row[0]
        if close != close:
            return state, (float("nan"),)
        level, seen = state if state is not None else (0.0, 0.0)
        level = level + (close - level) / (0.6 * period * (close / level) ** 4) if seen and level > 0 else close
        seen = min(seen + 1, period)
        return (level, seen), (level if seen >= period else float("nan"),)

    return step


@indicator("McGinley Dynamic", "Trend", "price", period=period(14, 2))
def mcginley(s, period):
    return s.stateful(f"mcginley{period}", _mcginley_step(period), [s.close], 1, 2)


@indicator("Rolling VWAP", "Trend", "price", period=period())
def rolling_vwap(s, period):
    return [s.sum(typical(s) * s.volume, period) / s.sum(s.volume, period)]


@indicator("Cumulative VWAP", "Trend", "price")
def vwap(s):
    value = typical(s) * s.volume
    volume = s.only_where(s.volume, value)
    ratio = s.running("sum", value) / s.running("sum", volume)
    return [s.only_where(ratio, value)]


@indicator("Bollinger Bands", "Trend", "price", BANDS, period=period(), mult=mult())
def bollinger(s, period, mult):
    middle, spread = s.mean(s.close, period), s.std(s.close, period, 0) * mult
    return [middle - spread, middle, middle + spread]


@indicator("Bollinger %B", "Trend", guides=(0, 1), period=period(), mult=mult())
def bollinger_pctb(s, period, mult):
    lower, middle, upper = bollinger(s, period, mult)
    spread = s.std(s.close, period, 0) * mult
    return [s.when(spread > 1e-12 * s.abs(middle), (s.close - middle + spread) / (2 * spread))]


@indicator("Keltner Channels", "Trend", "price", BANDS, period=period(), atrPeriod=(10, 1, 500), mult=mult())
def keltner(s, period, atrPeriod, mult):
    middle, reach = s.ema(s.close, period), atr_smooth(s, atrPeriod) * mult
    return [middle - reach, middle, middle + reach]


@indicator("Donchian Channels", "Trend", "price", BANDS, period=period())
def donchian(s, period):
    low, high = s.min(s.low, period), s.max(s.high, period)
    return [low, (high + low) / 2, high]


def _psar_step(step, ceiling):
    def advance(state, row):
        high, low, close, high1, low1, high2, low2, close1 = row
        nan = float("nan")
        if high != high or low != low or close != close:
            return None, (nan,)
        if state is None:
            return (1.0, 0.0, 0.0, 0.0, 0.0), (nan,)
        run, up, sar, extreme, pace = state
        if run == 1:
            up = float(close >= close1)
            sar = low1 if up else high1
            extreme = max(high1, high) if up else min(low1, low)
            return (2.0, up, sar, extreme, step), (sar,)
        sar += pace * (extreme - sar)
        sign = 1.0 if up else -1.0
        # In a downtrend the same rules hold for mirrored prices.
        guard = min(low1, low2) if up else max(high1, high2)
        sar = min(sar, guard) if up else max(sar, guard)
        against, along = (low, high) if up else (high, low)
        if sign * against < sign * sar:
            return (2.0, 1.0 - up, extreme, against, step), (extreme,)
        if sign * along > sign * extreme:
            extreme, pace = along, min(pace + step, ceiling)
        return (2.0, up, sar, extreme, pace), (sar,)

    return advance


@indicator("Parabolic SAR", "Trend", "price", step=(0.02, 0.001, 0.5, 0.001), maxStep=(0.2, 0.01, 1.0, 0.01))
def psar(s, step, maxStep):
    lags = [s.lag(s.high), s.lag(s.low), s.lag(s.high, 2), s.lag(s.low, 2), s.lag(s.close)]
    return s.stateful(f"psar{step}:{maxStep}", _psar_step(step, maxStep), [s.high, s.low, s.close, *lags], 1, 5)


def _supertrend_step(mult):
    def advance(state, row):
        high, low, close, atr, close1 = row
        nan = float("nan")
        if high != high or low != low or close != close or atr != atr:
            return None, (nan, nan)
        middle = (high + low) / 2
        above, below = middle + mult * atr, middle - mult * atr
        if state is None:
            trend = 1.0 if close >= middle else -1.0
        else:
            held_above, held_below, trend = state
            above = above if above < held_above or close1 > held_above else held_above
            below = below if below > held_below or close1 < held_below else held_below
            if trend < 0:
                trend = 1.0 if close > above else -1.0
            else:
                trend = -1.0 if close < below else 1.0
        return (above, below, trend), (below if trend > 0 else above, trend)

    return advance


def _supertrend(s, period, mult):
    inputs = [s.high, s.low, s.close, atr_smooth(s, period), s.lag(s.close)]
    return s.stateful(f"supertrend{mult}", _supertrend_step(mult), inputs, 2, 3)


@indicator("Supertrend", "Trend", "price", period=period(10), mult=mult(3.0))
def supertrend(s, period, mult):
    return [_supertrend(s, period, mult)[0]]


@indicator("Supertrend Direction", "Trend", guides=(0,), period=period(10), mult=mult(3.0))
def supertrend_direction(s, period, mult):
    return [_supertrend(s, period, mult)[1]]


@indicator("Linear Regression", "Trend", "price", period=period(20, 2))
def linreg(s, period):
    return [s.regression(s.close, period)[1]]


@indicator("Linear Regression Slope", "Trend", guides=(0,), period=period(20, 2))
def linreg_slope(s, period):
    return [s.regression(s.close, period)[0]]


@indicator("Linear Regression R-squared", "Trend", guides=(0.5,), period=period(20, 2))
def linreg_r2(s, period):
    return [s.regression(s.close, period)[2]]


@indicator(
    "Ichimoku Cloud", "Trend", "price", ("tenkan", "kijun", "senkou_a", "senkou_b"),
    tenkan=(9, 1, 200), kijun=(26, 1, 500), senkouB=(52, 1, 500),
)
def ichimoku(s, tenkan, kijun, senkouB):
    fast, base, wide = ((s.max(s.high, n) + s.min(s.low, n)) / 2 for n in (tenkan, kijun, senkouB))
    return [fast, base, (fast + base) / 2, wide]


@indicator("Average Directional Index", "Trend", outputs=("adx", "plus_di", "minus_di"), guides=(20, 25), period=period(14, 2))
def adx(s, period):
    up, down = s.diff(s.high), s.lag(s.low) - s.low

    def stronger(a, b):
        return s.row("dm", lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.when((x > y) & (x > 0), x).otherwise(0.0)), a, b)

    moved = s.row("notfirst", lambda first, tr: F.when(~first, tr), s.first_bar(), true_range(s))
    scale = s.wilder(moved, period)
    plus, minus = (100 * s.wilder(stronger(a, b), period) / scale for a, b in ((up, down), (down, up)))
    dx = s.row("dx", lambda p, m: F.when(p + m == 0, 0.0).otherwise(100 * F.abs(p - m) / F.nullif(p + m, F.lit(0.0))), plus, minus)
    return [s.wilder(dx, period), plus, minus]


@indicator("Aroon", "Trend", outputs=("up", "down", "osc"), guides=(50,), period=period(25, 1, 400))
def aroon(s, period):
    up, down = (
        100 * (period - s.bars_since(x, period + 1, highest)) / period for x, highest in ((s.high, True), (s.low, False))
    )
    return [up, down, up - down]


@indicator("Vortex", "Trend", outputs=("plus", "minus"), guides=(1,), period=period(14, 2))
def vortex(s, period):
    moved = s.row("notfirst", lambda first, tr: F.when(~first, tr), s.first_bar(), true_range(s))
    total = s.sum(moved, period)
    return [s.sum(s.abs(a - s.lag(b)), period) / total for a, b in ((s.high, s.low), (s.low, s.high))]


@indicator("Distance from SMA %", "Trend", guides=(0,), period=period())
def ma_distance(s, period):
    return [s.pct(s.close, s.mean(s.close, period))]


@indicator("Distance from EMA %", "Trend", guides=(0,), period=period())
def ema_distance(s, period):
    return [s.pct(s.close, s.ema(s.close, period))]


@indicator("Moving Average Envelope", "Trend", "price", BANDS, period=period(), percent=(2.5, 0.01, 50.0, 0.05))
def envelope(s, period, percent):
    middle = s.mean(s.close, period)
    return [middle * (1 - percent / 100), middle, middle * (1 + percent / 100)]


@indicator("Chandelier Exit", "Trend", "price", ("long", "short"), period=period(22), mult=mult(3.0))
def chandelier_exit(s, period, mult):
    reach = atr_smooth(s, period) * mult
    return [s.max(s.high, period) - reach, s.min(s.low, period) + reach]


@indicator("Median Price MA", "Trend", "price", period=period())
def median_price_ma(s, period):
    return [s.mean(midpoint(s), period)]
