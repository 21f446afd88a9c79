"""Image records as column expressions: types, chart sentiment, flow signals, quality, fusion of two readings, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image types with their patterns, in order of declaration and of priority; weights; words; thresholds.
TYPES = {
    "greeks_chart": ["delta", "gamma", "theta", "vega", "strike", "greeks", "exposure"],
    "flow_heatmap": ["heatmap", "flow", "volume", "interest", "notional", "size", "concentration"],
    "skew_chart": ["skew", "implied.*volatility", "iv", "term.*structure", "smile"],
    "price_chart": ["price", "btc", "eth", "usd", "candlestick", "chart", "timeframe"],
    "position_diagram": ["position", "strategy", "payoff", "profit.*loss", "breakeven"],
}
TYPE_WEIGHTS = {"greeks_chart": 1.0, "flow_heatmap": 0.9, "skew_chart": 0.8, "price_chart": 0.6, "position_diagram": 0.7}
OTHER_WEIGHT, LEAST_CONFIDENCE, SWING = 0.2, 0.3, 0.7
CHART_UP = ["bullish", "up", "green", "calls", "support", "breakout", "rally"]
CHART_DOWN = ["bearish", "down", "red", "puts", "resistance", "breakdown", "sell"]
FLOWS = {
    "large_call_buying": ["large call", "call sweep", "call volume"],
    "large_put_buying": ["large put", "put sweep", "put volume"],
    "unusual_activity": ["unusual", "spike", "heavy"],
    "skew_movement": ["skew", "implied vol", "iv"],
}
SIGNS_UP = ["call buying", "upside interest", "gamma squeeze", "skew eased", "bullish flow"]
SIGNS_DOWN = ["put buying", "hedging activity", "downside protection", "skew firmed", "bearish flow"]
MOST_BYTES, LEAST_SIDE = 10 * 1024 * 1024, 100
# End of fixed values.


def image_type(text: Column, url: Column) -> Column:
    """The type with most patterns found, two points in the text and one in the URL; of equals the first, without any unknown."""
    points = {k: sum((F.when(text.rlike(p), 2).otherwise(0) + F.when(url.rlike(p), 1).otherwise(0) for p in v), F.lit(0)) for k, v in TYPES.items()}
    most = F.greatest(*points.values())
    out = F.when(most == 0, "unknown")
    for k, n in points.items():
        out = out.when(n == most, k)
    return out


def times(text: Column, words: list[str]) -> Column:
    """How often the words' letters occur, inside other words too."""
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))


def chart_sentiment(text: Column) -> Column:
    up, down = times(text, CHART_UP), times(text, CHART_DOWN)
    return F.when(up > down, "bullish").when(down > up, "bearish").otherwise("neutral")


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def flow_signals(text: Column, kind: Column) -> Column:
    """Distinct signal names, sorted."""
    found = [F.when(kind.contains("flow"), "options_flow_detected"), *(F.when(any_of(text, v), k) for k, v in FLOWS.items())]
    return F.array_sort(F.array_compact(F.array(*found)))


def weight_of(kind: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for k, w in TYPE_WEIGHTS.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def quality(url: Column, kind: Column, size: Column, width: Column, height: Column, confidence: Column, status: Column) -> Column:
    """0 to 100 points of one image record; from 50 on it is valid."""
    known = kind.isin(list(TYPES))
    return (
        100
        - F.when(F.coalesce(url, F.lit("")) == "", 30).otherwise(0)
        - F.when(F.coalesce(size, F.lit(0)) > MOST_BYTES, 20).when(F.coalesce(size, F.lit(0)) == 0, 10).otherwise(0)
        - F.when((F.coalesce(width, F.lit(0)) < LEAST_SIDE) | (F.coalesce(height, F.lit(0)) < LEAST_SIDE), 25).otherwise(0)
        - F.when(kind == "unknown", 15).when(~known, 10).otherwise(0)
        - F.when(F.coalesce(confidence, F.lit(0.0)) <= 0, 10).when(confidence < 0.3, 20).otherwise(0)
        - F.when(F.coalesce(status, F.lit("")) != "completed", 25).otherwise(0)
    )


def fused(one: Column, two: Column) -> Column:
    """Two readings as one: their mean, as 1, 0 and -1, beyond 0.3 either way; a missing reading isn't counted."""
    value = lambda s: F.when(s == "bullish", 1.0).when(s == "bearish", -1.0).when(s.isNotNull(), 0.0)
    both = F.array_compact(F.array(value(one), value(two)))
    mean = F.try_divide(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), F.size(both))
    return F.when(mean > 0.3, "bullish").when(mean < -0.3, "bearish").otherwise("neutral")


def as_share(confidence: Column) -> Column:
    """A confidence that may be in percent."""
    return F.when(confidence > 1, confidence / 100).otherwise(confidence)


def found_date(text: Column) -> Column:
    """The first date of a text: yyyy-mm-dd, else m/d/y with two-digit years up to 30 in this century; null if there is none such day."""
    iso = F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    m, d, y = (F.regexp_extract(text, r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})", k) for k in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.concat(F.when(y.try_cast("int") <= 30, "20").otherwise("19"), y)).otherwise(y)
    us = F.concat(year, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    return F.coalesce(iso.try_cast("date"), us.try_cast("date"))


def json_attempts(raw: Column) -> list[Column]:
    """A reply without its code fences, and the same with trailing commas repaired in three ways, in order of trial."""
    s = F.trim(F.regexp_replace(raw, r"^[ \t\r\n]*```[a-zA-Z]*[ \t]*\n|\n[ \t]*```[ \t\r\n]*$", ""))
    swap = lambda x, *pairs: x if not pairs else swap(F.replace(x, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:])
    repairs = [[(",\n}\n", "\n}\n"), (",\n]", "\n]")], [(",\n}", "\n}"), (",\n]", "\n]")], [(",}", "}"), (",]", "]")]]
    return [s, *(swap(s, *r) for r in repairs)]
