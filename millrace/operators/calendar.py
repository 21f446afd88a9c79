"""Calendar resampling: week and month ends, and spines without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_end(d: Column) -> Column:
    """The Sunday that ends the week; a Sunday is its own."""
    return F.next_day(F.date_sub(d, 1), "SUN")


def month_end(d: Column) -> Column:
    return F.last_day(d)


def period_end(d: Column, freq: str) -> Column:
    return {"W": week_end, "M": month_end}[freq](d)


def spine(df: DataFrame, date: str, freq: str, name: str = "period") -> DataFrame:
    """Every period from df's first to its last, empty ones too; freq: D, W or M.  An empty table has none."""
    lo, hi = F.min(date), F.max(date)
    if freq == "D":
        steps = F.sequence(lo, hi)
    elif freq == "W":
        steps = F.sequence(week_end(lo), week_end(hi), F.expr("interval 7 days"))
    else:
        steps = F.transform(F.sequence(F.trunc(lo, "MM"), F.trunc(hi, "MM"), F.expr("interval 1 month")), F.last_day)
    return df.agg(steps.alias("s")).select(F.explode("s").alias(name))


def compound(r: Column, unit: str = "fraction") -> Column:
    """The return of holding through all periods' returns, in the same unit."""
    one = 100.0 if unit == "percent" else 1.0
    return (F.product(1 + r / one) - 1) * one


def ohlcv(prices: DataFrame, freq: str, unit: str = "fraction") -> DataFrame:
    """(asset, period, open, high, low, close, volume, ret, mean_vol) of a daily frame with return_1d and volatility."""
    return prices.groupBy("asset", period_end(F.col("date"), freq).alias("period")).agg(
        F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"),
        compound(F.col("return_1d"), unit).alias("ret"),
        F.avg("volatility").alias("mean_vol"),
    )


def filled(periods: DataFrame, *frames: DataFrame, key: str = "period") -> DataFrame:
    """Frames joined to the spine, with zeros for what they lack."""
    out = periods
    for f in frames:
        out = out.join(f, key, "left")
    numeric = [c for c, t in out.dtypes if t in ("double", "bigint", "int")]
    return out.na.fill(0, numeric)
