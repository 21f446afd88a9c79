"""Exact quantiles under heavy tails, ties and few values, and when sketches miss."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import carry
from millrace.operators.carry import cuts, quantiles

SHARES = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.75, "e": 0.999, "f": 1.0}


def held_against_numpy(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: [r[n] for n in SHARES] for r in quantiles(df, "k", "v", SHARES).collect()}
    want = {}
    for k, v in rows:
        if k is not None and v is not None:
            want.setdefault(k, []).append(v)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(np.quantile(v, list(SHARES.values())).tolist(), rel=1e-12), k


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(carry, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    rows = [("normal", rng.gauss(0, 1)) for _ in range(6000)]
    rows += [("tail", rng.random()) for _ in range(3000)] + [("tail", 1e15), ("tail", -1e12)]
    rows += [("ties", float(rng.choice([1, 1, 1, 2, 3]))) for _ in range(3000)] + [("same", 7.0)] * 500
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("three", 5.0), ("three", -1.0), ("three", 0.0), ("none", None), (None, 1.0)]
    held_against_numpy(spark, rows)


def test_bounds_that_miss_are_replaced(spark, monkeypatch):
    """A sketch that says the same two values for everything."""
    real = F.percentile_approx
    monkeypatch.setattr(carry.F, "percentile_approx", lambda c, p, a=10_000: F.transform(F.array(*map(F.lit, p)), lambda _: F.max(c)) if a == carry.ACCURACY else real(c, p, a))
    rng = random.Random(2)
    held_against_numpy(spark, [("x", rng.gauss(0, 1)) for _ in range(800)])


def test_whole_columns_long_values_and_an_empty_table(spark):
    df = spark.range(1001).select((F.col("id") * 5 % 1001).alias("v"))
    assert cuts(df, "v", {"lo": 0.25, "hi": 0.9995}).collect() == [(250.0, 999.5)]
    assert cuts(df.limit(0), "v", {"lo": 0.25}).collect() == []


def test_one_far_value_leaves_the_work_spread(spark):
    """What is sorted is a few of many rows, whatever the range of the values."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 5, 1e15).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e9).alias("v"))
    out = quantiles(df, "k", "v", {"m": 0.5})
    want = np.quantile([r.v for r in df.collect()], 0.5)
    assert out.first().m == pytest.approx(want, rel=1e-12)
    near = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles() if "/wanted-" in f})
    w = near.first()["_w"][0]
    assert df.where(F.col("v").between(w["lo"], w["hi"])).count() <= 4 * 200_000 / carry.ACCURACY + 2


def test_sketches_that_never_say_the_same_twice(spark, monkeypatch):
    """As on a cluster, where a sketch's parts arrive in another order each time that it is worked out."""
    real = F.percentile_approx
    once = lambda p, by: [min(1.0, max(0.0, q + by)) for q in p]
    chance = F.expr("reflect('java.lang.Math', 'random')").cast("double") > 0.5
    monkeypatch.setattr(carry.F, "percentile_approx", lambda c, p, a=10_000: F.when(chance, real(c, once(p, -0.02), a)).otherwise(real(c, once(p, 0.02), a)))
    monkeypatch.setattr(carry, "ACCURACY", 25)
    rng = random.Random(3)
    held_against_numpy(spark, [(str(k), rng.gauss(0, 1)) for k in range(60) for _ in range(200)])
