"""Weights and thresholds of the score, searched for over all articles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.search import evolve, moments
from millrace.plans.registry import query
from millrace.plans.returns import facts
from millrace.sources.scratch import kept

# The components' weights, the bounds of weights and thresholds, and the threshold at the start.
COMPONENTS = ["text", "image", "market", "meta"]
START = [0.3, 0.4, 0.2, 0.1, 0.3]
WEIGHT_BOUNDS = [(0.1, 0.5), (0.2, 0.6), (0.1, 0.4), (0.05, 0.2)]
CONFIDENCE_BOUNDS = (0.1, 0.9)
# End of fixed values.

#: Each target and what it varies: the weights, the least confidence, or both.
TARGETS = {"information_ratio": "weights", "hit_rate": "weights", "correlation": "weights", "precision": "threshold", "recall": "threshold", "f1": "threshold", "combined": "both"}


def scored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, the four components, confidence, ret): articles' seven-day returns."""
    f = facts(spark, sf_dir).where("days = 7 AND ret IS NOT NULL")
    side = F.when(F.col("bias") == "bullish", 1.0).when(F.col("bias") == "bearish", -1.0).otherwise(0.0)
    weekday = F.when(F.weekday("date") >= 5, 0.1).otherwise(-0.05)
    return f.select("date", (F.col("signal") - 0.5).alias("text"), side.alias("image"), (F.col("confidence") - 0.5).alias("market"), weekday.alias("meta"), "confidence", "ret")


def scores(sums: dict[str, np.ndarray], everything: float) -> np.ndarray:
    """(points, TARGETS) from the sums of search.moments(); nan where a metric has no meaning."""
    with np.errstate(divide="ignore", invalid="ignore"):
        n = sums["n"]
        mean = sums["pnl"] / n
        ratio = mean / np.sqrt(np.maximum(sums["pnl2"] / n - mean**2, 0))
        hit = sums["hits"] / n
        cov = sums["s_ret"] / n - sums["s"] * sums["ret"] / n**2
        r = cov / np.sqrt((sums["s2"] / n - (sums["s"] / n) ** 2) * (sums["ret2"] / n - (sums["ret"] / n) ** 2))
        precision = np.where(sums["strong"] > 0, sums["strong_hits"] / sums["strong"], 0)
        recall = sums["strong"] / max(1.0, everything)
        f1 = np.where(precision + recall > 0, 2 * precision * recall / (precision + recall), 0)
        out = np.stack([ratio, hit, np.abs(r), precision, recall, f1, 0.4 * ratio + 0.3 * hit + 0.3 * np.abs(r)], axis=1)
    return np.round(out, 9)  # sums of another order of tasks give the same scores


def tuned(train: DataFrame, test: DataFrame, seed: int = 42, size: int = 20, generations: int = 25) -> list[tuple]:
    """A row for each target: its score at START, the best found on train, the point, and the same point's score on test."""
    rows, rows_test = (float(df.where("ret IS NOT NULL AND confidence IS NOT NULL").count()) for df in (train, test))
    free = {"weights": (True, False), "threshold": (False, True), "both": (True, True)}
    bounds = []
    for what in TARGETS.values():
        weights, threshold = free[what]
        bounds.append(np.array([*(WEIGHT_BOUNDS if weights else [(x, x) for x in START[:4]]), CONFIDENCE_BOUNDS if threshold else (START[4],) * 2], dtype=float))
    start = np.array(START)
    found = evolve(lambda points: scores(moments(train, COMPONENTS, points), rows), bounds, start, seed, size, generations)
    base = scores(moments(train, COMPONENTS, start[None]), rows)[0]
    later = scores(moments(test, COMPONENTS, np.stack([f.point for f in found])), rows_test)
    out = []
    for k, (name, f) in enumerate(zip(TARGETS, found, strict=True)):
        w = f.point[:4] / f.point[:4].sum()
        gain = float((f.score - base[k]) / abs(base[k]) * 100) if base[k] and np.isfinite(base[k]) else None
        number = lambda x: float(x) if np.isfinite(x) else None
        out.append((name, number(base[k]), number(f.score), gain, *map(float, w), float(f.point[4]), number(later[k, k]), f.generations, f.converged))
    return out


@query()
def optimization_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target the best weights and least confidence within their bounds, fitted on the first four fifths of the time and judged on the rest.

    Seven seeded searches in step: each generation of all of them is one pass over the articles.
    """
    # As many files as tasks can run: every generation reads them all.
    f = kept(scored_facts(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism), "scored-facts")
    span = f.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    cut = span.a + (span.b - span.a) * 0.8 if span.a else None
    rows = tuned(f.where(F.col("date") <= F.lit(cut)), f.where(F.col("date") > F.lit(cut)))
    return spark.createDataFrame(rows, "target string, baseline double, optimized double, improvement_pct double, text double, image double, market double, meta double, least_confidence double, validation double, generations int, converged boolean")
