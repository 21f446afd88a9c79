"""Steps of the market queries whose memory or time grew too fast: what they do, and that results stay."""

from datetime import datetime, timedelta

from millrace.plans import timing


def test_price_at_works_on_hours(spark, monkeypatch):
    """one join in buckets of hours and none of days; a day with prices decides alone; a point without time keeps its row."""
    import random

    r = random.Random(4)
    start = datetime(2024, 1, 1)
    ticks = [(a, start + timedelta(minutes=r.randrange(6 * 1440)), float(i), i) for a in "xy" for i in range(40)]
    ticks = [t for t in ticks if t[1].day != 3] + [("x", datetime(2024, 1, 4, 0, 5), 777.0, 900), ("x", datetime(2024, 1, 2, 23, 50), 778.0, 901)]
    points = [(i, a, start + timedelta(minutes=r.randrange(6 * 1440))) for i, a in enumerate("xy" * 150)]
    points += [(900, "x", datetime(2024, 1, 3, 0, 5)), (901, "x", datetime(2024, 1, 4, 0, 0)), (902, "x", None), (903, None, start), (904, "z", start)]
    real, spans = timing.nearest, []
    monkeypatch.setattr(timing, "nearest", lambda *a: spans.append(a[8]) or real(*a))
    got = timing.price_at(spark.createDataFrame(points, "id long, asset string, at timestamp"), spark.createDataFrame(ticks, "asset string, ts timestamp, price double, event_id long"), ["id"]).collect()

    def price(asset, at):
        if asset is None or at is None:
            return None
        mine = [(abs(t[1] - at), t[1], t[3], t[2]) for t in ticks if t[0] == asset]
        own = [t for t in mine if t[1].date() == at.date()]
        best = min(own or mine, default=None)
        return best[3] if best and best[0] <= timedelta(hours=1) else None

    assert {(x.id, x.price) for x in got} == {(i, price(a, at)) for i, a, at in points} and len(got) == len(points)
    assert spans == [4 * timing.HOUR]


def test_ended_searches_cost_nothing():
    """points of a target that has converged are not judged again."""
    import numpy as np
    from millrace.operators.search import evolve

    asked = []

    def judge(points):
        asked.append(len(points))
        return np.stack([np.zeros(len(points)), -np.abs(points[:, 0] - 0.3)], axis=1)

    flat, peak = evolve(judge, [np.array([(0.0, 1.0)])] * 2, np.array([0.9]), size=8, generations=30)
    assert (flat.generations, flat.converged) == (1, True) and abs(peak.point[0] - 0.3) < 0.01
    assert asked[:3] == [16, 16, 8]  # the first generation, one of both, and then the other target's alone


def test_moments_of_shared_weights(spark):
    """points that share weights and points that don't give the sums of a plain loop."""
    import numpy as np
    from millrace.operators.search import SUMS, moments

    r = np.random.default_rng(3)
    rows = [(*map(float, r.normal(0, 0.3, 2)), float(r.integers(0, 10)) / 10, float(r.normal())) for _ in range(300)] + [(0.0, 0.0, 0.9, 1.0), (0.5, 0.0, 0.5, 0.0), (None, 0.4, 0.5, -1.0), (0.1, 0.1, None, 1.0)]
    points = np.array([(0.5, 0.5, 0.3), (0.5, 0.5, 0.8), (0.5, 0.5, 0.3), (0.2, 0.8, 0.3), (0.9, 0.1, 0.3), (0.4, 0.6, 2.0)])
    got = moments(spark.createDataFrame(rows, "a double, b double, confidence double, ret double"), ["a", "b"], points)
    for k, (a, b, least) in enumerate(points):
        want = dict.fromkeys(SUMS, 0.0)
        for x, y, c, ret in rows:
            if c is None or c < least:
                continue
            s = ((x or 0) * a + (y or 0) * b) / (a + b)
            pnl = np.sign(s) * ret
            for n, v in zip(SUMS, (1, pnl, pnl**2, pnl > 0, s, s**2, s * ret, ret, ret**2, abs(s) >= 0.1, abs(s) >= 0.1 and pnl > 0), strict=True):
                want[n] += float(v)
        assert all(np.isclose(got[n][k], want[n]) for n in SUMS)


def test_merge_works_a_batch_out_once(spark, tmp_path):
    """a merged batch is computed once, a batch that is in already not at all, and nothing of it stays beside the table."""
    from millrace.sources.bucketed import BucketedTable
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def tell(x):
        seen.add(1)
        return x

    table = BucketedTable.create(spark, f"file://{tmp_path}/t", "k long, v long", ["k"], 4)
    rows = spark.range(20).select(F.udf(tell, "long")("id").alias("k"), F.col("id").alias("v"))  # the buckets need the function too
    assert table.merge(rows, ["v"], "one") and seen.value == 20
    assert not table.merge(rows, ["v"], "one") and seen.value == 20 and table.has("one") and not table.has("two") and not table.has(None)
    assert sorted(map(tuple, table.read().collect())) == [(i, i) for i in range(20)]
    assert not list((tmp_path / "t" / "incoming").iterdir())
