"""Queries over whole tables, against plain Python."""

import datetime as dt
from collections import defaultdict

SF = "/root/testdata/sf0.001"


def test_sliding_counts_all(spark):
    from millrace.plans.scores import sliding_counts_all

    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "event_type", "unix_micros(cast(ts AS timestamp)) AS us").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.event_type].append(r.us)
    count = lambda r, hours: sum(0 <= r.us - x <= hours * 3_600_000_000 for x in by[r.event_type])
    got = {r.event_id: (r.last_hour, r.last_day) for r in sliding_counts_all(spark, SF).collect()}
    assert got == {r.event_id: (count(r, 1), count(r, 24)) for r in rows}


def test_day_queries_take_all_rows(spark):
    from millrace.plans.returns import inter_event_returns_all, price_nearest_7d_all, theme_transitions_all
    from millrace.tables import articles, daily

    close = {(r.asset, r.date): r.close for r in daily(spark, SF).collect()}
    got = {(r.asset, r["at"]): r.close for r in price_nearest_7d_all(spark, SF).collect()}
    want = {}
    for asset, date in close:
        at = date + dt.timedelta(days=3)
        near = [(abs(k), k, at + dt.timedelta(days=k)) for k in range(-7, 8) if (asset, at + dt.timedelta(days=k)) in close]
        want[asset, at] = close[asset, min(near)[2]] if near else None
    assert got == want
    days = defaultdict(set)
    for r in articles(spark, SF).collect():
        days[r.asset].add(r.date)
    pairs = {(a, x, y) for a, d in days.items() for x, y in zip(sorted(d), sorted(d)[1:]) if (y - x).days <= 30}
    assert {(r.asset, r.date, r.next_date) for r in inter_event_returns_all(spark, SF).collect()} == pairs
    assert 0 <= len(pairs) - sum(r.n for r in theme_transitions_all(spark, SF).collect()) <= 36


def test_inter_event_returns_all(spark):
    import duckdb
    import pytest
    from millrace.plans.returns import INTER_ALL, inter_event_returns_all

    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    want = con.sql(f"WITH {INTER_ALL} SELECT asset, date, next_date, gap, theme, next_theme, next_signal - signal, ret FROM inter ORDER BY asset, date").fetchall()
    got = [tuple(r) for r in inter_event_returns_all(spark, SF).orderBy("asset", "date").select("asset", "date", "next_date", "gap", "theme", "next_theme", "signal_change", "ret").collect()]
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for a, b in zip(got, want, strict=True) for k in (6, 7))


def test_sliding_counts_grow_with_the_events(spark):
    """Edges to the microsecond, equal times and missing ones; and no window is gone through row by row, as a frame that moves at both ends is."""
    import random

    from millrace.plans.scores import sliding

    rng = random.Random(5)
    hour, day = 3_600_000_000, 86_400_000_000
    base = [rng.choice([0, 1, hour, day - 1, day, 2 * day - 1, 3 * day]) for _ in range(60)]
    times = [b + rng.choice([-1, 0, 0, 1, hour, hour + 1, -hour - 1, day]) for b in base] + [None] * 3
    rows = [(i, rng.choice(["a", "b", None]) if t is not None else "a", t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, us long").selectExpr("event_id", "event_type", "timestamp_micros(us) AS ts")
    out = sliding(df)

    def count(r, span):
        same = [t for _, a, t in rows if a == r[1]]
        return sum(t is None for t in same) if r[2] is None else sum(t is not None and 0 <= r[2] - t <= span for t in same)

    assert {r.event_id: (r.last_hour, r.last_day) for r in out.collect()} == {r[0]: (count(r, hour), count(r, day)) for r in rows}
    frames = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("specifiedwindowframe(")[1:]]
    assert frames and all("unboundedpreceding" in f.split(")")[0].lower() for f in frames)
