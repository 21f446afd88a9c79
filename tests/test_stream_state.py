"""Streams over several files: state is evicted when the watermark has passed, and results stay those of one pass."""

import datetime as dt
import random

import pytest

from millrace.sources.scratch import fresh
from millrace.streaming.alerts import COOLDOWN, MOST, ROCKSDB, limited
from millrace.streaming.queries import EVENTS, alert_stream, first_of_day

START = dt.datetime(2024, 3, 1)


def rows_of(day, n, rng):
    return [(day * 1000 + i, START + dt.timedelta(days=day, seconds=rng.randrange(86_400)), rng.randrange(8), rng.choice("abc"), rng.choice([5.0, 25.0, 30.0, 60.0]), None) for i in range(n)]


@pytest.fixture
def days(spark):
    """A file for each of eight days with events, six days of them busy, and one event long after."""
    rng, path, rows = random.Random(5), fresh(spark, "days"), []
    for day in [0, 1, 2, 3, 4, 5, 9, 30]:
        own = rows_of(day, 150 if day < 9 else 1, rng)
        rows += own
        spark.createDataFrame(own, EVENTS).coalesce(1).write.parquet(f"{path}/day={day:02d}")
    return path, rows


def run(spark, path, make, delay):
    files = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)
    from pyspark.sql import functions as F

    stream = make(files.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay))
    out, kept = [], []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        q = stream.writeStream.outputMode("append").option("checkpointLocation", fresh(spark, "at")).trigger(availableNow=True).foreachBatch(lambda b, _: out.extend(b.collect())).start()
        q.awaitTermination()
        kept = [sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out, kept


def test_first_rows_of_a_day_and_their_state(spark, days):
    path, rows = days
    out, kept = run(spark, path, first_of_day, "24 hours")
    want = {(r[2], r[3], r[1].date()) for r in rows}
    assert len(out) == len(want) and {(r.user_id, r.event_type, r.day.date()) for r in out} == want
    assert max(kept) <= 3 * 8 * 3  # three days of keys at most, not all
    assert kept[-1] <= 1


def folded(rows):
    """The limits over all rows in order, with lists of all that was ever sent."""
    out = {}
    for asset in {r[3] for r in rows}:
        sent = []
        for r in sorted((r for r in rows if r[3] == asset and r[4] > 20), key=lambda r: (r[1], r[0])):
            t, name = int((r[1] - dt.datetime(1970, 1, 1)).total_seconds()), f"{asset}_{round(r[4] / 50, 1)}"
            ok = sum(s // 3600 == t // 3600 for s, _ in sent) < MOST and not any(n == name and t - s < COOLDOWN for s, n in sent)
            sent += [(t, name)] * ok
            out[r[0], asset] = (name, ok, sum(s // 3600 > t // 3600 - 24 for s, _ in sent))
    return out


def test_limits_and_their_state(spark, days):
    path, rows = days
    out, kept = run(spark, path, lambda e: limited(alert_stream(e)), "10 minutes")
    got = {(r.event_id, r.asset): (r.signature, r.sent, r.sent_24h) for r in out}
    assert got == folded(rows) and len(out) == len(got)
    assert {s for _, s, _ in got.values()} == {True, False}
    busy = max(kept)
    assert kept[-1] < busy / 4, kept  # the last day's one event, and nothing of the days before
