"""Article scores: four components, their weighted sum and confidence, adaptive weights, and alert levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Component weights, thresholds and words.
WEIGHTS = {"text": 0.30, "image": 0.40, "market": 0.20, "meta": 0.10}
URGENT = ["breaking", "urgent", "alert", "massive", "huge", "unprecedented"]
EXTREME, SIGNIFICANT, CONFIDENT = 0.5, 0.3, 0.7
ADAPTIVE = [(0.8, 1.3), (0.6, 1.0), (0.4, 0.7)]
# End of fixed values.


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def text_component(direction: Column, strikes: Column, notionals: Column, mentioned: Column) -> Column:
    base = F.when(direction == "bullish", 0.6).when(direction == "bearish", -0.6).otherwise(0.0)
    return clip(base * F.least(F.lit(1.0), (strikes + notionals) * 0.1 + 0.7) * F.when(mentioned, 1.0).otherwise(0.8), -1.0, 1.0)


def market_component(ret_24h: Column) -> tuple[Column, Column]:
    """(score, confidence).  It looks ahead: the score of an article is made from the return after it.  Pass a trailing
    return for a score that doesn't."""
    score = F.when(ret_24h > 0.05, 0.6).when(ret_24h < -0.05, -0.6).when(ret_24h > 0.02, 0.3).when(ret_24h < -0.02, -0.3).otherwise(0.0)
    return score, F.when(ret_24h.isNotNull(), 0.8).otherwise(0.2)


def meta_component(ts: Column, title: Column, length: Column, asset: Column) -> tuple[Column, Column]:
    """(score, confidence) from time of publication, urgent words, the asset in the title, and length."""
    t = F.lower(title)
    urgent = F.lit(False)
    for w in URGENT:
        urgent = urgent | t.contains(w)
    score = (
        F.when(F.weekday(ts) >= 5, 0.1).otherwise(0.0)
        + F.when(F.hour(ts).between(9, 16), 0.1).otherwise(0.0)
        + F.when(urgent, 0.2).otherwise(0.0)
        + F.when(t.contains(F.lower(asset)), 0.1).otherwise(0.0)
        + F.when(length > 2000, 0.05).otherwise(0.0)
    )
    return clip(score, -1.0, 1.0), clip(0.5 + F.when(length > 2000, 0.1).when(length < 500, -0.1).otherwise(0.0), 0.0, 1.0)


def weighted(scores: dict[str, Column]) -> Column:
    return clip(sum((scores[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)), -1.0, 1.0)


def confidence(parts: dict[str, Column]) -> Column:
    """The weighted mean, less 0.2 for a weak text and 0.3 for weak images."""
    mean = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return clip(mean - F.when(parts["text"] < 0.3, 0.2).otherwise(0.0) - F.when(parts["image"] < 0.3, 0.3).otherwise(0.0), 0.0, 1.0)


def adaptive_weights(base: dict[str, float], parts: dict[str, Column]) -> dict[str, Column]:
    """Weights times 1.3, 1.0, 0.7 or 0.5 by confidence, summing to one."""
    raw = {}
    for k, w in base.items():
        factor = F.lit(0.5)
        for least, times in reversed(ADAPTIVE):
            factor = F.when(parts[k] >= least, times).otherwise(factor)
        raw[k] = factor * w
    total = sum(raw.values(), F.lit(0.0))
    return {k: F.coalesce(F.try_divide(v, total), F.lit(1 / len(base))) for k, v in raw.items()}


def alert_level(score: Column, conf: Column) -> Column:
    """extreme, significant, or info where the score or the confidence is too small."""
    return F.when((conf >= CONFIDENT) & (F.abs(score) >= EXTREME), "extreme").when((conf >= CONFIDENT) & (F.abs(score) >= SIGNIFICANT), "significant").otherwise("info")


def label(score: Column) -> Column:
    return F.when(score > 0.5, "strong_bullish").when(score > 0.3, "bullish").when(score >= -0.3, "neutral").when(score >= -0.5, "bearish").when(score.isNotNull(), "strong_bearish")
