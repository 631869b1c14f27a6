"""Momentum indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators.ind_trend import falling_part, midpoint, period, rising_part, typical
from barloom.operators.registry import indicator
from barloom.operators.series import Ref, Series


def strength(s: Series, change: Ref, period: int) -> Ref:
    """Relative strength of a change series: 100 without losses (50 without gains too), 0 without gains."""
    gain = s.wilder(rising_part(s, change), period)
    loss = s.wilder(falling_part(s, change), period)

    def ratio(g, l):
        value = F.when(l == 0, F.when(g > 0, 100.0).otherwise(50.0)).when(g == 0, 0.0)
        return F.when(g.isNotNull() & l.isNotNull(), value.otherwise(100 - 100 / (1 + F.try_divide(g, l))))

    return s.row("rs", ratio, gain, loss)


def position(s: Series, x: Ref, high: Ref, low: Ref) -> Ref:
    return 100 * (x - low) / (high - low)


def rank_of(s: Series, x: Ref, n: int) -> Ref:
    """Percent of the previous ``n`` values strictly below the current one."""
    previous = s.collected(x, -n, -1, "window", lambda values: values)
    return s.row("rank", lambda v, w: 100.0 * F.size(F.filter(w, lambda e: e < v)) / n, x, previous)


def linear4(s: Series, x: Ref) -> Ref:
    return (x + 2 * s.lag(x, 1) + 2 * s.lag(x, 2) + s.lag(x, 3)) / 6


@indicator("Relative Strength Index", "Momentum", guides=(30, 70), period=period(14, 2))
def rsi(s, period):
    return [strength(s, s.diff(s.close), period)]


@indicator("Stochastic Oscillator", "Momentum", outputs=("k", "d"), guides=(20, 80), period=period(14), kSmooth=(3, 1, 100), dPeriod=(3, 1, 100))
def stochastic(s, period, kSmooth, dPeriod):
    raw = position(s, s.close, s.max(s.high, period), s.min(s.low, period))
    k = s.clamp(s.mean(raw, kSmooth), 0, 100)
    return [k, s.clamp(s.mean(k, dPeriod), 0, 100)]


@indicator(
    "Stochastic RSI", "Momentum", outputs=("k", "d"), guides=(20, 80),
    rsiPeriod=(14, 2, 200), stochPeriod=(14, 2, 200), kSmooth=(3, 1, 100), dPeriod=(3, 1, 100),
)
def stoch_rsi(s, rsiPeriod, stochPeriod, kSmooth, dPeriod):
    value = strength(s, s.diff(s.close), rsiPeriod)
    raw = position(s, value, s.max(value, stochPeriod), s.min(value, stochPeriod))
    k = s.clamp(s.mean(raw, kSmooth), 0, 100)
    return [k, s.clamp(s.mean(k, dPeriod), 0, 100)]


@indicator("MACD", "Momentum", outputs=("macd", "signal", "hist"), guides=(0,), fast=(12, 1, 200), slow=(26, 2, 500), signal=(9, 1, 200))
def macd(s, fast, slow, signal):
    line = s.ema(s.close, fast) - s.ema(s.close, slow)
    average = s.ema(line, signal)
    return [line, average, line - average]


@indicator("Rate of Change %", "Momentum", guides=(0,), period=period(12))
def roc(s, period):
    return [s.roc(s.close, period)]


@indicator("Momentum", "Momentum", guides=(0,), period=period(10))
def momentum(s, period):
    return [s.diff(s.close, period)]


@indicator("Commodity Channel Index", "Momentum", guides=(-100, 100), period=(20, 2, 300))
def cci(s, period):
    price = typical(s)
    mean = s.mean(price, period)
    values = s.collected(price, 1 - period, 0, "window", lambda v: v)
    spread = s.row(
        "mad", lambda w, m: F.aggregate(w, F.lit(0.0), lambda acc, x: acc + F.abs(x - m)) / period, values, mean
    )
    return [s.when(spread > 1e-12 * s.abs(mean), (price - mean) / (0.015 * spread))]


@indicator("Williams %R", "Momentum", guides=(-80, -20), period=period(14))
def williams_r(s, period):
    return [s.clamp(position(s, s.close, s.max(s.high, period), s.min(s.low, period)) - 100, -100, 0)]


@indicator("True Strength Index", "Momentum", guides=(0,), long=(25, 2, 300), short=(13, 1, 200))
def tsi(s, long, short):
    change = s.diff(s.close)
    return [100 * s.ema(s.ema(change, long), short) / s.ema(s.ema(s.abs(change), long), short)]


@indicator("Ultimate Oscillator", "Momentum", guides=(30, 70), short=(7, 1, 100), mid=(14, 1, 200), long=(28, 1, 400))
def ultimate_oscillator(s, short, mid, long):
    before = s.lag(s.close)
    floor = s.least(s.low, before)
    pressure, reach = s.close - floor, s.greatest(s.high, before) - floor
    a, b, c = (s.sum(pressure, n) / s.sum(reach, n) for n in (short, mid, long))
    return [s.clamp(100 * (4 * a + 2 * b + c) / 7, 0, 100)]


def awesome(s, fast, slow):
    return s.mean(midpoint(s), fast) - s.mean(midpoint(s), slow)


@indicator("Awesome Oscillator", "Momentum", guides=(0,), fast=(5, 1, 200), slow=(34, 2, 500))
def awesome_oscillator(s, fast, slow):
    return [awesome(s, fast, slow)]


@indicator("Accelerator Oscillator", "Momentum", guides=(0,), fast=(5, 1, 200), slow=(34, 2, 500), smooth=(5, 1, 200))
def accelerator_oscillator(s, fast, slow, smooth):
    line = awesome(s, fast, slow)
    return [line - s.mean(line, smooth)]


@indicator("Chande Momentum Oscillator", "Momentum", guides=(-50, 50), period=period(14))
def cmo(s, period):
    change = s.diff(s.close)
    up, down = s.sum(rising_part(s, change), period), s.sum(falling_part(s, change), period)
    return [s.row("cmo", lambda u, d: F.when(u + d == 0, 0.0).otherwise(100 * F.try_divide(u - d, u + d)), up, down)]


@indicator("TRIX", "Momentum", guides=(0,), period=period(15))
def trix(s, period):
    return [s.roc(s.ema(s.ema(s.ema(s.close, period), period), period), 1)]


@indicator("Percentage Price Oscillator", "Momentum", outputs=("ppo", "signal", "hist"), guides=(0,), fast=(12, 1, 200), slow=(26, 2, 500), signal=(9, 1, 200))
def ppo(s, fast, slow, signal):
    slower = s.ema(s.close, slow)
    line = 100 * (s.ema(s.close, fast) - slower) / slower
    average = s.ema(line, signal)
    return [line, average, line - average]


@indicator("Absolute Price Oscillator", "Momentum", guides=(0,), fast=(12, 1, 200), slow=(26, 2, 500))
def apo(s, fast, slow):
    return [s.ema(s.close, fast) - s.ema(s.close, slow)]


@indicator("Detrended Price Oscillator", "Momentum", guides=(0,), period=period())
def dpo(s, period):
    return [s.lag(s.close, period // 2 + 1) - s.mean(s.close, period)]


def _fisher_step(state, row):
    middle, high, low = row
    nan = float("nan")
    if high != high or low != low:
        return None, (nan, nan)
    span = high - low
    if span == 0:
        return state, (nan, nan)
    import math

    x, f = state if state is not None else (0.0, 0.0)
    x = min(0.999, max(-0.999, 0.66 * ((middle - low) / span - 0.5) + 0.67 * x))
    value = 0.5 * math.log((1 + x) / (1 - x)) + 0.5 * f
    return (x, value), (value, f if state is not None else nan)


@indicator("Fisher Transform", "Momentum", outputs=("fisher", "signal"), guides=(0,), period=period(10, 2))
def fisher(s, period):
    middle = midpoint(s)
    return s.stateful("fisher", _fisher_step, [middle, s.max(middle, period), s.min(middle, period)], 2, 2)


@indicator(
    "Connors RSI", "Momentum", outputs=("crsi", "rsi", "streak_rsi", "percent_rank"), guides=(20, 80),
    rsiPeriod=(3, 2, 100), streakPeriod=(2, 2, 100), rankPeriod=(100, 2, 200),
)
def connors_rsi(s, rsiPeriod, streakPeriod, rankPeriod):
    change = s.diff(s.close)
    sign = s.row("sign", lambda c, d: F.when(c.isNotNull(), F.coalesce(F.signum(d), F.lit(0.0))), s.close, change)
    same = s.row("same", lambda a, b: F.when(a.isNotNull(), F.when((a == b) & (a != 0), 1.0).otherwise(0.0)), sign, s.lag(sign))
    price = strength(s, change, rsiPeriod)
    streak = strength(s, s.diff(s.affine(same, sign)), streakPeriod)
    rank = rank_of(s, s.roc(s.close, 1), rankPeriod)
    return [(price + streak + rank) / 3, price, streak, rank]


@indicator(
    "Know Sure Thing", "Momentum", outputs=("kst", "signal"), guides=(0,),
    roc1=(10, 1, 300), roc2=(15, 1, 300), roc3=(20, 1, 300), roc4=(30, 1, 300),
    sma1=(10, 1, 200), sma2=(10, 1, 200), sma3=(10, 1, 200), sma4=(15, 1, 200), signal=(9, 1, 200),
)
def kst(s, roc1, roc2, roc3, roc4, sma1, sma2, sma3, sma4, signal):
    a, b, c, d = (
        weight * s.mean(s.roc(s.close, lag), n)
        for weight, lag, n in ((1, roc1, sma1), (2, roc2, sma2), (3, roc3, sma3), (4, roc4, sma4))
    )
    line = (a + b) + (c + d)
    return [line, s.mean(line, signal)]


@indicator("Coppock Curve", "Momentum", guides=(0,), longRoc=(14, 1, 300), shortRoc=(11, 1, 300), wmaPeriod=(10, 1, 200))
def coppock(s, longRoc, shortRoc, wmaPeriod):
    return [s.wma(s.roc(s.close, longRoc) + s.roc(s.close, shortRoc), wmaPeriod)]


@indicator("Relative Vigor Index", "Momentum", outputs=("rvi", "signal"), guides=(0,), period=period(10))
def rvi(s, period):
    line = s.mean(linear4(s, s.close - s.open), period) / s.mean(linear4(s, s.high - s.low), period)
    return [line, linear4(s, line)]


@indicator("Balance of Power", "Momentum", guides=(0,), period=period(14))
def bop(s, period):
    body, span = s.close - s.open, s.high - s.low
    return [s.mean(s.row("bop", lambda b, r: F.when(r == 0, 0.0).otherwise(F.try_divide(b, r)), body, span), period)]


@indicator("Elder Ray", "Momentum", outputs=("bull", "bear"), guides=(0,), period=period(13))
def elder_ray(s, period):
    average = s.ema(s.close, period)
    return [s.high - average, s.low - average]


@indicator("Chande Forecast Oscillator", "Momentum", guides=(0,), period=period(14, 2))
def cfo(s, period):
    return [100 * (s.close - s.regression(s.close, period)[1]) / s.close]


@indicator("QStick", "Momentum", guides=(0,), period=period(8))
def qstick(s, period):
    return [s.mean(s.close - s.open, period)]


@indicator("Relative Momentum Index", "Momentum", guides=(30, 70), period=period(14, 2), lookback=(5, 1, 100))
def rmi(s, period, lookback):
    return [strength(s, s.diff(s.close, lookback), period)]
