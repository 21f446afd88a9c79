"""Technical indicators over an asset's days, in the two published variants.

`full(n, ...)` stands for a rolling figure that needs n rows without nulls, as the usual rolling windows do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

YEAR = 365.0


def days() -> WindowSpec:
    """An asset's days in order."""
    return W.partitionBy("asset").orderBy("date")


def last(n: int) -> WindowSpec:
    return days().rowsBetween(-(n - 1), 0)


def full(n: int, over: Column, f) -> Column:
    """f(over) over the last n rows, null unless all n are there and not null."""
    return F.when(F.count(over).over(last(n)) == n, f(over).over(last(n)))


def percentile_rank(x: Column, n: int) -> Column:
    """Average rank of the row's value among the last n, times 100 / n."""
    rows = F.collect_list(x).over(last(n))
    below = F.size(F.filter(rows, lambda y: y < x))
    same = F.size(F.filter(rows, lambda y: y == x))
    return F.when(F.size(rows) == n, (below + (same + 1) / 2) / n * 100)


def indicators(prices: DataFrame, variant: str = "a") -> DataFrame:
    """prices (asset, date, open, high, low, close, volume) with the indicators of variant a or b; ratios over zero are null."""
    open_, high, low, close, volume = (F.col(c) for c in ("open", "high", "low", "close", "volume"))
    before = F.lag("close").over(days())
    df = prices.withColumns(
        {
            "mid_price": (high + low) / 2,
            "price_range": high - low,
            "price_range_pct": F.try_divide(high - low, close) * 100,
            "return_1d": F.try_divide(close, before) - 1,
            "log_return_1d": F.when((close > 0) & (before > 0), F.log(close / before)),
            "return_overnight": F.try_divide(open_, before) - 1,
            "return_intraday": F.try_divide(close, open_) - 1,
            "gap_size": open_ - before,
            "gap_size_pct": F.try_divide(open_ - before, before) * 100,
            "dollar_volume": volume * close,
            "upper_wick": high - F.greatest(open_, close),
            "lower_wick": F.least(open_, close) - low,
            "body_size": F.abs(close - open_),
            "body_size_pct": F.try_divide(F.abs(close - open_), close) * 100,
        }
    )
    r = F.col("return_1d")
    width = 14 if variant == "a" else 20
    rolled = {"return_1d_bps": r * 10000}
    for n in (7, 14, 30):
        rolled[f"volatility_{n}d"] = full(n, r, F.stddev_samp) * F.sqrt(F.lit(YEAR)) * 100
        rolled[f"sma_{n}"] = full(n, close, F.avg)
    for n in (30, 60, 90):
        rolled[f"price_percentile_{n}d"] = percentile_rank(close, n)
    rolled["support_level"] = full(width, low, F.min)
    rolled["resistance_level"] = full(width, high, F.max)
    if variant == "a":
        rolled["volume_ratio"] = F.try_divide(volume, full(20, volume, F.avg))
        rolled["vwap_approx"] = F.try_divide(full(20, volume * close, F.sum), full(20, volume, F.sum))
        rolled["is_gap_up"], rolled["is_gap_down"] = F.col("gap_size") > 0, F.col("gap_size") < 0
        rolled["is_local_high"] = (high > F.lag("high").over(days())) & (high > F.lead("high").over(days()))
        rolled["is_local_low"] = (low < F.lag("low").over(days())) & (low < F.lead("low").over(days()))
    else:
        around = days().rowsBetween(-2, 2)
        rolled["volume_ratio"] = F.try_divide(volume, full(30, volume, F.avg))
        rolled["vwap_approx"] = (high + low + close) / 3
        rolled["is_gap_up"], rolled["is_gap_down"] = F.col("gap_size_pct") > 1.0, F.col("gap_size_pct") < -1.0
        rolled["is_local_high"] = high == F.max(high).over(around)
        rolled["is_local_low"] = low == F.min(low).over(around)
    df = df.withColumns(rolled)
    move = F.col("volatility_30d") / F.sqrt(F.lit(YEAR))
    derived = {
        "implied_move_1d": move if variant == "a" else move * close,
        "distance_to_support": F.try_divide(close - F.col("support_level"), close) * 100,
        "distance_to_resistance": F.try_divide(F.col("resistance_level") - close, close) * 100,
    }
    for n in (7, 14, 30):
        derived[f"price_vs_sma_{n}"] = (F.try_divide(close, F.col(f"sma_{n}")) - 1) * 100
    return df.withColumns(derived)
