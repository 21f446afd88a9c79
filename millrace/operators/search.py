"""Bounded global search: differential evolution, then a compass search, each generation of points judged in one pass over the data.

The search itself is a few numbers on the driver; what grows with the data is `judge`, which gets all points of a generation at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Judges points (k, d): a score for each point and target, larger is better.
Judge = Callable[[np.ndarray], np.ndarray]


@dataclass
class Found:
    point: np.ndarray
    score: float
    generations: int
    converged: bool


def evolve(judge: Judge, bounds: list[np.ndarray], start: np.ndarray, seed: int = 42, size: int = 24, generations: int = 40, tolerance: float = 1e-3, least_step: float = 1 / 128) -> list[Found]:
    """The best point for each target, all searches in step with each other.

    bounds: for each target a (d, 2) array; equal ends fix a coordinate.  start is one point of every first generation, the rest a Latin
    hypercube.  A trial replaces its parent if it is better or equal; scores that are not numbers lose.  The search ends when a
    target's scores all lie within `tolerance` of each other, then the best point is moved along single coordinates by steps from an eighth of
    the range down to least_step of it: the scores are steps themselves (hits, signs), so gradients say nothing.
    """
    rng = np.random.default_rng(seed)
    low, high = (np.stack([b[:, i] for b in bounds])[:, None, :] for i in (0, 1))
    targets, d = len(bounds), low.shape[2]

    def judged(points: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Scores (targets, k) of each live target's own points; targets that have ended cost nothing."""
        k, on = points.shape[1], np.flatnonzero(live)
        scores = judge(points[on].reshape(-1, d)).reshape(len(on), k, targets)
        own = np.full((targets, k), -np.inf)
        own[on] = scores[np.arange(len(on)), :, on]
        return np.where(np.isfinite(own), own, -np.inf)

    cells = np.stack([np.stack([rng.permutation(size) for _ in range(d)], axis=1) for _ in range(targets)])
    points = low + (cells + rng.random((targets, size, d))) / size * (high - low)
    points[:, 0] = np.clip(start, low[:, 0], high[:, 0])
    scores = judged(points, np.full(targets, True))
    ended = np.full(targets, -1)
    for g in range(1, generations + 1):
        best = points[np.arange(targets), scores.argmax(axis=1)][:, None, :]
        # Two other members for each; the step's length is drawn anew every generation.
        others = np.argsort(rng.random((targets, size, size)) + 2 * np.eye(size), axis=2)[:, :, :2]
        pick = lambda i: np.take_along_axis(points, others[:, :, i, None], axis=1)  # noqa: B023, E731
        mutant = best + rng.uniform(0.5, 1.0) * (pick(0) - pick(1))
        outside = (mutant < low) | (mutant > high)
        mutant = np.where(outside, low + rng.random(mutant.shape) * (high - low), mutant)
        cross = rng.random(mutant.shape) < 0.7
        cross[..., :] |= rng.integers(0, d, (targets, size))[..., None] == np.arange(d)
        trial = np.where(cross, mutant, points)
        new = judged(trial, ended < 0)
        better = (new >= scores) & (ended < 0)[:, None]
        points, scores = np.where(better[..., None], trial, points), np.where(better, new, scores)
        spread = scores.max(axis=1) - scores.min(axis=1)
        ended = np.where((ended < 0) & (spread <= tolerance), g, ended)
        if (ended > 0).all():
            break
    converged, ended = ended > 0, np.where(ended > 0, ended, g)
    at = scores.argmax(axis=1)
    best, score = points[np.arange(targets), at], scores[np.arange(targets), at]
    step = np.full(targets, 1 / 8)
    ways = np.concatenate([np.eye(d), -np.eye(d)])
    while (step >= least_step).any():
        near = np.clip(best[:, None, :] + step[:, None, None] * ways * (high - low), low, high)
        new = judged(near, step >= least_step)
        at, top = new.argmax(axis=1), new.max(axis=1)
        moved = (top > score) & (step >= least_step)
        best, score = np.where(moved[:, None], near[np.arange(targets), at], best), np.where(moved, top, score)
        step = np.where(moved, step, step / 2)
    return [Found(best[t], float(score[t]), int(ended[t]), bool(converged[t])) for t in range(targets)]


#: Names of the sums that moments() gives for each point.
SUMS = ("n", "pnl", "pnl2", "hits", "s", "s2", "s_ret", "ret", "ret2", "strong", "strong_hits")
#: Rows times points that are multiplied at once: they stay in a core's cache, and too few for numpy to start threads beside the task's own.
CELLS = 40_000


def moments(df: DataFrame, components: list[str], points: np.ndarray, strong: float = 0.1) -> dict[str, np.ndarray]:
    """For each point, sums over the rows of df whose confidence reaches the point's last coordinate.

    The score s of a row is its components times the point's other coordinates, divided by their sum; pnl is sign(s) * ret, and a row with
    |s| >= strong counts as strong.  Null components count as 0, rows without ret or confidence don't count.  Each task
    multiplies its rows with all points, batch by batch, and sends one row for each point.
    """
    weights, of = np.unique(points[:, :-1] / points[:, :-1].sum(axis=1, keepdims=True), axis=0, return_inverse=True)
    of, least = of.reshape(-1), points[:, -1]
    # Points that differ in their last coordinate alone share a row's score; the others are multiplied in groups of one last coordinate.
    shared, single = (np.flatnonzero(f(np.bincount(of)[of])) for f in (lambda n: n > 1, lambda n: n == 1))
    many = [(w, shared[of[shared] == w]) for w in np.unique(of[shared])]
    groups = [(c, single[least[single] == c]) for c in np.unique(least[single])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), len(least)))
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
            parts, confidence, ret = x[:-2], x[-2], x[-1]
            for w, at in many:
                # A row counts for the points whose last coordinate it reaches: sums by its place among them, added up from the largest.
                at = at[np.argsort(least[at])]
                place = np.searchsorted(least[at], confidence, side="right")
                s = sum(p * y for p, y in zip(parts, weights[w], strict=True))
                pnl, hard = np.sign(s) * ret, np.abs(s) >= strong
                for i, v in enumerate((None, pnl, pnl**2, pnl > 0, s, s**2, s * ret, ret, ret**2, hard, hard & (pnl > 0))):
                    total[i, at] += np.bincount(place, v, len(at) + 1)[:0:-1].cumsum()[::-1]
            for c, at in groups:
                use = confidence >= c
                mine, r = parts[:, use], ret[use]
                values = np.stack([np.ones(len(r)), r, r**2, r > 0, r < 0])
                total[np.ix_([SUMS.index(n) for n in ("n", "ret", "ret2")], at)] += values[:3].sum(axis=1)[:, None]
                step = max(1, CELLS // len(at))
                for a in range(0, len(r), step):
                    v = values[:, a : a + step]
                    s = sum(p[a : a + step, None] * y for p, y in zip(mine, weights[of[at]].T, strict=True))
                    # Sums of the values over the rows that a score takes up, down, and as far as strong.
                    up, down, far_up, far_down = (v @ m.astype(float) for m in (s > 0, s < 0, (s >= strong) & (s > 0), (s <= -strong) & (s < 0)))
                    level = (s == 0).sum(axis=0) if strong <= 0 else 0
                    found = {"pnl": up[1] - down[1], "pnl2": up[2] + down[2], "hits": up[3] + down[4], "s": s.sum(axis=0), "s2": (s * s).sum(axis=0), "s_ret": v[1] @ s, "strong": far_up[0] + far_down[0] + level, "strong_hits": far_up[3] + far_down[4]}
                    for n, y in found.items():
                        total[SUMS.index(n), at] += y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(least))), *map(pa.array, total)], names=["point", *SUMS])

    rows = df.where("ret IS NOT NULL AND confidence IS NOT NULL").select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(components)], F.col("confidence").cast("double"), F.col("ret").cast("double"))
    sums = rows.mapInArrow(run, "point long, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("point").agg(*[F.sum(c).alias(c) for c in SUMS])
    out = {c: np.zeros(len(least)) for c in SUMS}
    for r in sums.collect():  # a row for each point
        for c in SUMS:
            out[c][r["point"]] = r[c]
    return out
