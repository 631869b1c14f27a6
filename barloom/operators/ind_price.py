"""Price, volatility and statistics indicators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.operators.ind_momentum import rank_of
from barloom.operators.ind_trend import atr_smooth, midpoint, mult, period, true_range, typical
from barloom.operators.registry import indicator
from barloom.operators.series import Ref, Series

YEAR = (252, 1, 525_600)


def window(default=20, low=2, high=500):
    return (default, low, high)


def close_location(s: Series) -> Ref:
    span, lean = s.high - s.low, 2 * s.close - s.high - s.low
    return s.row("clv", lambda r, x: F.when(r == 0, F.when(x.isNotNull(), 0.0)).otherwise(F.try_divide(x, r)), span, lean)


def annual(s: Series, variance: Ref, periods: int) -> Ref:
    return s.sqrt(variance * periods) * 100


# --- volatility --------------------------------------------------------------------------------


@indicator("True Range", "Volatility")
def true_range_(s):
    return [true_range(s)]


@indicator("Average True Range (SMA)", "Volatility", period=period(14))
def atr(s, period):
    return [s.mean(true_range(s), period)]


@indicator("Average True Range (Wilder)", "Volatility", period=period(14))
def atr_wilder(s, period):
    return [atr_smooth(s, period)]


@indicator("Normalised ATR %", "Volatility", period=period(14))
def natr(s, period):
    return [100 * atr_smooth(s, period) / s.close]


@indicator("Return Standard Deviation %", "Volatility", window=window())
def stdev_returns(s, window):
    return [s.std(100 * s.change(s.close), window, 1)]


@indicator("Historical Volatility %", "Volatility", window=window(), periodsPerYear=YEAR)
def hist_vol(s, window, periodsPerYear):
    return [s.std(s.log_change(s.close), window, 1) * math.sqrt(periodsPerYear) * 100]


@indicator("Parkinson Volatility", "Volatility", window=window(), periodsPerYear=YEAR)
def parkinson(s, window, periodsPerYear):
    span = s.ln(s.high / s.low)
    return [annual(s, s.mean(span * span / (4 * math.log(2)), window), periodsPerYear)]


@indicator("Garman-Klass Volatility", "Volatility", window=window(), periodsPerYear=YEAR)
def garman_klass(s, window, periodsPerYear):
    span, body = s.ln(s.high / s.low), s.ln(s.close / s.open)
    return [annual(s, s.mean(0.5 * (span * span) - (2 * math.log(2) - 1) * (body * body), window), periodsPerYear)]


def _excursion(s: Series) -> Ref:
    return s.ln(s.high / s.close) * s.ln(s.high / s.open) + s.ln(s.low / s.close) * s.ln(s.low / s.open)


@indicator("Rogers-Satchell Volatility", "Volatility", window=window(), periodsPerYear=YEAR)
def rogers_satchell(s, window, periodsPerYear):
    return [annual(s, s.mean(_excursion(s), window), periodsPerYear)]


@indicator("Yang-Zhang Volatility", "Volatility", window=window(), periodsPerYear=YEAR)
def yang_zhang(s, window, periodsPerYear):
    blend = 0.34 / (1.34 + (window + 1) / (window - 1))
    overnight = s.var(s.ln(s.open / s.lag(s.close)), window, 1)
    intraday = s.var(s.ln(s.close / s.open), window, 1)
    return [annual(s, overnight + blend * intraday + (1 - blend) * s.mean(_excursion(s), window), periodsPerYear)]


def _ewma_vol(s, warmup, periodsPerYear, **named):
    change = s.log_change(s.close)
    return [annual(s, s.ewm(change * change, 1 - named["lambda"], warmup), periodsPerYear)]


_ewma_vol.__name__ = "ewma_vol"
indicator(
    "EWMA Volatility", "Volatility", **{"lambda": (0.94, 0.5, 0.999, 0.005)}, warmup=(20, 2, 500), periodsPerYear=YEAR
)(_ewma_vol)


@indicator("Chaikin Volatility", "Volatility", guides=(0,), period=period(10), rocPeriod=(10, 1, 200))
def chaikin_volatility(s, period, rocPeriod):
    return [s.roc(s.ema(s.high - s.low, period), rocPeriod)]


@indicator("Ulcer Index", "Volatility", period=period(14))
def ulcer_index(s, period):
    peak = s.max(s.close, period)
    fall = s.when(peak > 0, 100 * (s.close - peak) / peak)
    return [s.sqrt(s.mean(fall * fall, period))]


@indicator("Donchian Width %", "Volatility", period=period())
def donchian_width(s, period):
    high, low = s.max(s.high, period), s.min(s.low, period)
    return [200 * (high - low) / (high + low)]


@indicator("Bollinger Bandwidth %", "Volatility", period=period(), mult=mult())
def bollinger_bandwidth(s, period, mult):
    return [200 * mult * s.std(s.close, period, 0) / s.mean(s.close, period)]


@indicator("Choppiness Index", "Volatility", guides=(38.2, 61.8), period=period(14, 2))
def choppiness(s, period):
    travelled = s.sum(true_range(s), period)
    span = s.max(s.high, period) - s.min(s.low, period)
    ratio = s.row("chop", lambda t, r: F.when((r > 0) & (t > 0), F.log10(t / r) / math.log10(period)), travelled, span)
    return [s.clamp(100 * ratio, 0, 100)]


@indicator("Range over ATR", "Volatility", guides=(1,), period=period(14))
def range_atr(s, period):
    return [(s.high - s.low) / atr_smooth(s, period)]


@indicator("Mass Index", "Volatility", guides=(27,), emaPeriod=(9, 1, 100), sumPeriod=(25, 1, 200))
def mass_index(s, emaPeriod, sumPeriod):
    single = s.ema(s.high - s.low, emaPeriod)
    return [s.sum(single / s.ema(single, emaPeriod), sumPeriod)]


# --- statistics --------------------------------------------------------------------------------


@indicator("Simple Return %", "Statistics", guides=(0,))
def simple_return(s):
    return [s.roc(s.close, 1)]


@indicator("Log Return %", "Statistics", guides=(0,))
def log_return(s):
    return [100 * s.log_change(s.close)]


@indicator("Rolling Return %", "Statistics", guides=(0,), period=(20, 1, 1000))
def rolling_return(s, period):
    return [s.roc(s.close, period)]


@indicator("Mean Return %", "Statistics", guides=(0,), window=window())
def mean_return(s, window):
    return [s.mean(100 * s.change(s.close), window)]


@indicator("Rolling Z-Score", "Statistics", guides=(-2, 0, 2), window=window())
def zscore(s, window):
    mean, spread = s.mean(s.close, window), s.std(s.close, window, 1)
    return [s.when(spread > 1e-12 * s.abs(mean), (s.close - mean) / spread)]


@indicator("Percent Rank", "Statistics", guides=(20, 50, 80), window=(100, 2, 250))
def percent_rank(s, window):
    return [rank_of(s, s.close, window)]


def _shape(s: Series, x: Ref, n: int, label: str, agg, corrected, least: int) -> Ref:
    mean, spread = s.mean(x, n), s.var(x, n, 0)
    raw = s._strict(label, agg, x, n, least)
    return s.row(f"{label}c{n}", lambda v, m, q: F.when(q > 1e-24 * m * m, corrected(v)), raw, mean, spread)


@indicator("Rolling Skewness", "Statistics", guides=(0,), window=window(60, 4))
def skew(s, window):
    n = window
    return [_shape(s, s.change(s.close), n, "skew", F.skewness, lambda g: g * (math.sqrt(n * (n - 1)) / (n - 2)), 3)]


@indicator("Rolling Excess Kurtosis", "Statistics", guides=(0,), window=window(60, 5))
def kurtosis(s, window):
    n = window
    corrected = lambda g: ((n + 1) * g + 6) * ((n - 1) / ((n - 2) * (n - 3)))
    return [_shape(s, s.change(s.close), n, "kurt", F.kurtosis, corrected, 4)]


@indicator("Rolling Sharpe Ratio", "Statistics", guides=(0,), window=window(60), periodsPerYear=YEAR)
def sharpe(s, window, periodsPerYear):
    change = s.change(s.close)
    mean, spread = s.mean(change, window), s.std(change, window, 1)
    return [s.when(spread > 1e-12 * s.abs(mean), mean / spread) * math.sqrt(periodsPerYear)]


@indicator("Rolling Sortino Ratio", "Statistics", guides=(0,), window=window(60), periodsPerYear=YEAR)
def sortino(s, window, periodsPerYear):
    change = s.change(s.close)
    loss = s.row("loss", lambda r: F.when(r.isNotNull(), F.least(r, F.lit(0.0)) * F.least(r, F.lit(0.0))), change)
    mean, spread = s.mean(change, window), s.sqrt(s.mean(loss, window))
    return [s.when(spread > 1e-12 * s.abs(mean), mean / spread) * math.sqrt(periodsPerYear)]


@indicator("Drawdown from Running Peak", "Statistics", guides=(0,))
def drawdown(s):
    peak = s.running("max", s.close)
    return [s.when(peak > 0, s.pct(s.close, peak))]


@indicator("Rolling Max Drawdown", "Statistics", guides=(0,), window=window(60, 2))
def max_drawdown(s, window):
    def worst(values):
        begin = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("worst"))

        def step(acc, x):
            peak = F.greatest(acc["peak"], x)
            return F.struct(peak.alias("peak"), F.least(acc["worst"], x / peak - 1).alias("worst"))

        return F.aggregate(values, begin, step, lambda acc: F.when(acc["peak"] > 0, 100 * acc["worst"]))

    return [s.collected(s.close, 1 - window, 0, "worst", worst)]


@indicator("Highest High", "Statistics", "price", period=(20, 1, 1000))
def highest_high(s, period):
    return [s.max(s.high, period)]


@indicator("Lowest Low", "Statistics", "price", period=(20, 1, 1000))
def lowest_low(s, period):
    return [s.min(s.low, period)]


@indicator("Distance from High %", "Statistics", guides=(0,), period=(20, 1, 1000))
def distance_from_high(s, period):
    return [s.pct(s.close, s.max(s.high, period))]


@indicator("Distance from Low %", "Statistics", guides=(0,), period=(20, 1, 1000))
def distance_from_low(s, period):
    return [s.pct(s.close, s.min(s.low, period))]


@indicator("Return Autocorrelation", "Statistics", guides=(0,), window=window(30, 3), lag=(1, 1, 50))
def autocorrelation(s, window, lag):
    change = s.change(s.close)
    pair = s.row("pair", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b"))), change, s.lag(change, lag))
    # Every value from the oldest lagged one to the newest must be present.
    whole = s.window(f"whole{window + lag}", lambda c, l: F.count(c).over(l.rows(1 - window - lag)) == window + lag, change, window + lag - 1)
    shared = s._strict("cov", lambda c: F.covar_pop(c["a"], c["b"]), pair, window)
    own = s._strict("va", lambda c: F.var_pop(c["a"]), pair, window)
    other = s._strict("vb", lambda c: F.var_pop(c["b"]), pair, window)
    raw = s.when(own * other > 0, shared / s.sqrt(own * other))
    return [s.clamp(s.when(whole, raw), -1, 1)]


@indicator("Up-Bar Ratio %", "Statistics", guides=(50,), window=window())
def up_bar_ratio(s, window):
    up = s.row("isup", lambda r: F.when(r > 0, 1.0).when(r <= 0, 0.0), s.change(s.close))
    return [s.clamp(100 * s.mean(up, window), 0, 100)]


# --- price -------------------------------------------------------------------------------------


@indicator("Typical Price", "Price", "price")
def typical_price(s):
    return [typical(s)]


@indicator("Median Price", "Price", "price")
def median_price(s):
    return [midpoint(s)]


@indicator("Weighted Close", "Price", "price")
def weighted_close(s):
    return [(s.high + s.low + 2 * s.close) / 4]


@indicator("OHLC Average", "Price", "price")
def ohlc4(s):
    return [(s.open + s.high + s.low + s.close) / 4]


@indicator("Bar Range %", "Price")
def range_pct(s):
    return [100 * (s.high - s.low) / s.close]


@indicator("Candle Body %", "Price", guides=(0,))
def body_pct(s):
    return [100 * (s.close - s.open) / (s.high - s.low)]


@indicator("Upper Wick %", "Price")
def upper_wick_pct(s):
    return [100 * (s.high - s.greatest(s.open, s.close)) / (s.high - s.low)]


@indicator("Lower Wick %", "Price")
def lower_wick_pct(s):
    return [100 * (s.least(s.open, s.close) - s.low) / (s.high - s.low)]


@indicator("Gap % vs Previous Close", "Price", guides=(0,))
def gap_pct(s):
    return [s.pct(s.open, s.lag(s.close))]


@indicator("Close Location Value", "Price", guides=(0,))
def clv(s):
    return [close_location(s)]


@indicator("Intrabar Return %", "Price", guides=(0,))
def intraday_return(s):
    return [s.pct(s.close, s.open)]


@indicator("Close Change", "Price", guides=(0,))
def price_change(s):
    return [s.diff(s.close)]
