"""The bounded search: known optima, the judge against plain Python, and the score's weights against a grid."""

import datetime as dt
import math
import random
from itertools import product

import numpy as np

from millrace.operators.search import SUMS, evolve, moments
from millrace.plans import tuning


def test_known_optima_within_their_bounds():
    calls = []

    def judge(p):
        calls.append(len(p))
        bowl = -((p - np.array([0.3, 0.7, 2.0])) ** 2).sum(axis=1)
        waves = -(10 * 3 + (((p - 0.4) * 5) ** 2 - 10 * np.cos(2 * math.pi * (p - 0.4) * 5)).sum(axis=1))
        steps = np.floor(20 * p[:, 0]) - np.floor(20 * np.abs(p[:, 1] - 0.5))
        return np.stack([bowl, waves, np.where(p[:, 2] > 0.9, np.nan, steps)], axis=1)

    box = np.array([[0.0, 1.0]] * 3)
    found = evolve(judge, [box, box, np.array([[0.0, 1.0], [0.0, 1.0], [0.25, 0.25]])], np.array([0.5, 0.5, 0.5]), size=30, generations=150, tolerance=1e-9)
    assert np.allclose(found[0].point, [0.3, 0.7, 1.0], atol=0.01)  # the optimum lies outside: its nearest point
    assert np.allclose(found[1].point, 0.4, atol=0.01)
    assert found[2].score >= 19 and found[2].point[2] == 0.25
    assert all((box[:, 0] <= f.point).all() and (f.point <= box[:, 1]).all() for f in found)
    again = evolve(judge, [box] * 3, np.array([0.5] * 3), seed=7, generations=5)
    assert [a.point.tolist() for a in again] == [a.point.tolist() for a in evolve(judge, [box] * 3, np.array([0.5] * 3), seed=7, generations=5)]


def table(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        x = [rng.uniform(-1, 1) for _ in range(4)]
        ret = 0.05 * x[0] - 0.01 * x[1] + 0.02 * x[2] + rng.gauss(0, 0.02)
        rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=i % 90), *x, rng.random(), ret))
    rows += [(dt.date(2024, 1, 1), 1.0, None, 0.5, 0.5, 0.9, 0.1), (dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, None, 0.1), (dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 0.5, None)]
    return rows, spark.createDataFrame(rows, "date date, text double, image double, market double, meta double, confidence double, ret double").repartition(3)


def slow(rows, point):
    use = [r for r in rows if r[5] is not None and r[6] is not None and r[5] >= point[4]]
    total = sum(point[:4])
    s = [sum((x or 0) * w / total for x, w in zip(r[1:5], point[:4], strict=True)) for r in use]
    ret = [r[6] for r in use]
    pnl = [(a > 0) * b - (a < 0) * b for a, b in zip(s, ret, strict=True)]
    n, mean = len(use), sum(pnl) / len(use)
    ir = mean / math.sqrt(sum((p - mean) ** 2 for p in pnl) / n)
    hit = sum(p > 0 for p in pnl) / n
    ms, mr = sum(s) / n, sum(ret) / n
    r = sum((a - ms) * (b - mr) for a, b in zip(s, ret, strict=True)) / math.sqrt(sum((a - ms) ** 2 for a in s) * sum((b - mr) ** 2 for b in ret))
    hard = [p for a, p in zip(s, pnl, strict=True) if abs(a) >= 0.1]
    precision, recall = sum(p > 0 for p in hard) / len(hard), len(hard) / 601
    return [ir, hit, abs(r), precision, recall, 2 * precision * recall / (precision + recall), 0.4 * ir + 0.3 * hit + 0.3 * abs(r)]


def test_every_point_is_judged_as_by_plain_python(spark):
    rows, df = table(spark)
    rng = np.random.default_rng(3)
    points = rng.uniform(0.1, 0.6, (7, 5))
    got = tuning.scores(moments(df, tuning.COMPONENTS, points), 601.0)
    assert np.allclose(got, [slow(rows, p) for p in points], atol=1e-6)
    none = moments(df.limit(0), tuning.COMPONENTS, points)
    assert all((none[c] == 0).all() for c in SUMS)


def test_the_search_is_no_worse_than_a_grid(spark):
    rows, df = table(spark)
    out = {r[0]: r for r in tuning.tuned(df, df, generations=15)}
    grid = np.array([(*w, t) for w in product(*[np.linspace(a, b, 4) for a, b in tuning.WEIGHT_BOUNDS]) for t in (0.1, 0.3, 0.6)])
    best = tuning.scores(moments(df, tuning.COMPONENTS, grid), 601.0)
    for k, (name, what) in enumerate(tuning.TARGETS.items()):
        same = grid[:, 4] == 0.3 if what == "weights" else np.ones(len(grid), bool)
        if what != "threshold":
            assert out[name][2] >= best[same, k].max() - 1e-9, name
        assert out[name][2] >= out[name][1]
        assert out[name][2] == out[name][9]  # judged on the same rows
        assert math.isclose(sum(out[name][4:8]), 1)
    assert out["recall"][8] < 0.11  # the least confidence lets most in


def test_the_query(spark):
    rows = tuning.optimization_search(spark, "/root/testdata/sf0.001").collect()
    assert [r.target for r in rows] == list(tuning.TARGETS)
    assert all(r.optimized >= r.baseline for r in rows)
