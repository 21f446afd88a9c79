"""Stored tables: merges, replacements, replays, two writers, bytes written, and the refreshed view against a full rebuild."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.plans.returns import event_returns_of
from millrace.plans.stored import ReturnsView
from millrace.sources.bucketed import BucketedTable, ConcurrentWrite
from millrace.sources.scratch import fresh

SCHEMA = "k long, v string, at long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_merges_equal_a_dictionary(spark):
    rng, table, want = random.Random(2), BucketedTable.create(spark, fresh(spark, "t"), SCHEMA, ["k"], 8), {}
    assert rows(table.read()) == []
    for n in range(5):
        new = {rng.choice([*range(40), None]): (f"v{n}", rng.randrange(4)) for _ in range(25)}
        assert table.merge(spark.createDataFrame([(k, *v) for k, v in new.items()], SCHEMA), ["at"], f"batch {n}")
        for k, v in new.items():
            if k not in want or v[1] >= want[k][1]:
                want[k] = v
        assert rows(table.read()) == sorted(((k, *v) for k, v in want.items()), key=lambda r: tuple((x is not None, x) for x in r))
    before = table.versions()
    assert not table.merge(spark.createDataFrame([(1, "replayed", 99)], SCHEMA), ["at"], "batch 3")
    assert table.versions() == before
    table.merge(spark.createDataFrame([], SCHEMA), ["at"], "nothing")
    assert len(rows(table.read())) == len(want)
    assert rows(table.read(version=2)) != rows(table.read())


def size(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def test_a_small_batch_writes_little_and_old_files_can_go(spark):
    path = fresh(spark, "t")
    table = BucketedTable.create(spark, path, SCHEMA, ["k"], 32)
    table.merge(spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(1).cast("long").alias("at")), ["at"])
    whole = size(spark, f"{path}/data")
    table.merge(spark.createDataFrame([(5, "new", 2), (5, "older", 1)], SCHEMA), ["at"])
    assert size(spark, f"{path}/data") - whole < whole / 16
    assert table.read().where("k = 5").collect()[0].v == "new" and table.read().count() == 200_000
    assert table.vacuum(keep=2) == 0
    table.merge(spark.createDataFrame([(5, "newer", 3)], SCHEMA), ["at"])
    table.merge(spark.createDataFrame([(5, "newest", 4)], SCHEMA), ["at"])
    assert table.vacuum(keep=1) == 2  # the two small writes in between
    assert table.read().count() == 200_000 and len(table.versions()) == 1


def test_the_second_of_two_writers_fails(spark):
    table = BucketedTable.create(spark, fresh(spark, "t"), SCHEMA, ["k"], 4)
    old = table.state()
    table.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA), ["at"])
    with pytest.raises(ConcurrentWrite):
        table._rewrite(old, spark.createDataFrame([(2, "b", 1)], SCHEMA), lambda a, b: a.unionByName(b), None)
    assert rows(table.read()) == [(1, "a", 1)]


def test_children_are_deleted_and_inserted(spark):
    table = BucketedTable.create(spark, fresh(spark, "t"), SCHEMA, ["k"], 8)
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 1), (None, "d", 1), (3, "e", 1)], SCHEMA)
    table.replace(first, first, "one")
    parents = spark.createDataFrame([(1,), (2,), (None,), (9,)], "k long")
    children = spark.createDataFrame([(1, "x", 2), (None, "y", 2), (9, "z", 2), (3, "not of these parents", 2)], SCHEMA)
    for _ in range(2):
        table.replace(parents, children, "two")
        assert rows(table.read()) == rows(spark.createDataFrame([(1, "x", 2), (None, "y", 2), (9, "z", 2), (3, "e", 1)], SCHEMA))


def test_a_refreshed_view_equals_a_rebuilt_one(spark):
    rng, start = random.Random(8), dt.datetime(2024, 1, 1)
    at = lambda hours: start + dt.timedelta(seconds=int(rng.uniform(0, hours * 3600)))
    events = spark.createDataFrame([(i, rng.choice("ab"), at(400), rng.choice([0.4, 0.5, 0.9])) for i in range(60)], "article_id long, asset string, ts timestamp, confidence double")
    ticks = [(i, rng.choice("abc"), at(600), rng.uniform(1, 9)) for i in range(900)]
    ticks += [(1000 + i, a, t, p + 1) for i, (_, a, t, p) in enumerate(ticks[:50])]  # two prices at one time
    prices = spark.createDataFrame(ticks, "event_id long, asset string, ts timestamp, price double")
    view = ReturnsView.create(spark, fresh(spark, "view"), 4)
    early, late = events.where("article_id < 40"), events.where("article_id >= 40")
    parts = [prices.where(f"event_id % 3 = {k}") for k in range(3)]
    view.prices_came(early, parts[2], "a")
    view.prices_came(early, parts[0], "b")
    view.events_came(late, parts[2].unionByName(parts[0]), "c")
    assert rows(view.read()) == rows(event_returns_of(events, parts[2].unionByName(parts[0])))
    view.prices_came(events, parts[1], "d")
    want = rows(event_returns_of(events, prices))
    assert rows(view.read()) == want and len(want) > 20
    assert not view.prices_came(events, parts[1], "d") and not view.prices_came(events, parts[1].limit(0))
    view.prices_came(events, parts[1])  # without a name it is worked out again, and changes nothing
    assert rows(view.read()) == want
