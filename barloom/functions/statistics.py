"""Normal distribution helpers for small aggregated tables, as Arrow functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Acklam's rational approximation of the normal quantile.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_TAIL = 0.02425


def cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def _poly(coefficients, x: float) -> float:
    total = 0.0
    for c in coefficients:
        total = total * x + c
    return total


def ppf(p: float) -> float:
    """Normal quantile: the approximation above, refined by one Halley step."""
    if not 0.0 < p < 1.0:
        return math.nan if p != p else math.copysign(math.inf, p - 0.5)
    side = min(p, 1.0 - p)
    if side < ACKLAM_TAIL:
        q = math.sqrt(-2.0 * math.log(side))
        x = _poly(ACKLAM_C, q) / _poly((*ACKLAM_D, 1.0), q)
        x = x if p < 0.5 else -x
    else:
        q = p - 0.5
        x = _poly(ACKLAM_A, q * q) * q / _poly((*ACKLAM_B, 1.0), q * q)
    slip = (cdf(x) - p) * math.sqrt(2.0 * math.pi) * math.exp(x * x / 2.0)
    return x - slip / (1.0 + x * slip / 2.0)


@F.pandas_udf(T.DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.nan if v != v else cdf(v))


@F.pandas_udf(T.DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return p.map(ppf)
