"""Numbers within shards, running means over days, and folds of one key's rows, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import carry
from millrace.operators.carry import numbered
from millrace.operators.dedupe import best_of


@pytest.mark.parametrize("rows", [50, 10**9])
def test_numbers_in_order(spark, monkeypatch, rows):
    monkeypatch.setattr(carry, "RANGE_ROWS", rows)
    rng = random.Random(1)
    ids = list({rng.randint(-(2**62), 2**62) for _ in range(700)})
    df = spark.createDataFrame([(i, "x") for i in ids], "id long, v string").repartition(5)
    got = sorted((r.id, r.n, r.v) for r in numbered(df, F.when(F.col("id") % 3 == 0, F.col("id") % 3), "id", "n").collect())
    n, want = {True: 0, False: 0}, []
    for i in sorted(ids):
        own = i % 3 == 0
        n[own] += 1
        want.append((i, n[own], "x"))
    assert got == want
    assert numbered(df.limit(0), F.lit(1), "id", "n").collect() == []


def test_running_means(spark, tmp_path):
    from millrace.plans.reports import running_confidence

    rng = random.Random(2)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(200)), rng.choice([1, 2, None]), "t", rng.choice([None, rng.random()]), "") for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.running_mean for r in running_confidence(spark, str(tmp_path)).collect()}
    assert len(got) == 300
    for user in (1, 2, None):
        seen = []
        for i, *_, value, _ in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            seen += [value] if value is not None else []
            assert got[i] == (pytest.approx(sum(seen) / len(seen), abs=1e-4) if seen else None)


def test_a_fold_keeps_what_any_measure_improves(spark):
    rows = [("a", 1, 5, 1), ("a", 2, 4, 2), ("a", 3, 4, 2), ("a", 4, None, 3), ("a", 5, 1, None), ("b", 1, None, None), ("b", 2, None, None), (None, 1, 1, 1), (None, 2, 2, 0)]
    df = spark.createDataFrame(rows, "k string, o int, x int, y int").repartition(4)
    assert sorted(map(tuple, best_of(df, "k", "o", ["x", "y"]).collect()), key=str) == [("a", 5, 1, None), ("b", 1, None, None), (None, 2, 2, 0)]
    assert best_of(df.limit(0), "k", "o", ["x"]).collect() == []
