"""Statistics that the engine lacks: Student's t, and guarded ratios."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with df degrees of freedom: the regularised incomplete beta function as a continued fraction."""
    if not (math.isfinite(t) and df > 0):
        return math.nan
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    out = d
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d or tiny)
            c = 1 + up / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def t_p_value():
    """A function of columns t and degrees of freedom, for aggregated rows: one per group, not one per event."""

    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(n) else t_two_sided(x, n) for x, n in zip(t, df, strict=True)], dtype="float64")

    return F.pandas_udf(p, "double")


def correlation(x: str, y: str) -> Column:
    """Pearson's r, null where either side doesn't vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sx, sy = F.stddev_pop(F.when(both, F.col(x))), F.stddev_pop(F.when(both, F.col(y)))
    return F.try_divide(F.covar_pop(x, y), sx * sy)


def score_bucket(score: Column) -> Column:
    return F.when(score > 0.4, "strong_bullish").when(score > 0.1, "bullish").when(score >= -0.1, "neutral").when(score >= -0.4, "bearish").when(score.isNotNull(), "strong_bearish")
