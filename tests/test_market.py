"""Market queries against their SQL on the smallest tables, and edge rules on hand-made rows."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from millrace.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()  # noqa: F841
    sql.sql(f"CREATE OR REPLACE TEMP TABLE o AS {ORACLES[name]}")
    sql.register("got", got)
    sql.sql("CREATE OR REPLACE TEMP TABLE r AS SELECT * FROM got")
    cols = sorted(c[0] for c in sql.sql("DESCRIBE o").fetchall())
    assert cols == sorted(c[0] for c in sql.sql("DESCRIBE r").fetchall())
    c = ", ".join(f'"{x}"' for x in cols)
    for a, b in (("o", "r"), ("r", "o")):
        assert sql.sql(f"SELECT {c} FROM {a} EXCEPT ALL SELECT {c} FROM {b} LIMIT 3").fetchall() == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_student_t():
    from millrace.functions.stats import t_two_sided

    for t, df, p in ((2.228, 10, 0.05), (2.776, 4, 0.05), (1.0, 1, 0.5), (0.0, 7, 1.0), (4.032, 5, 0.01), (-1.96, 100000, 0.05)):
        assert math.isclose(t_two_sided(t, df), p, abs_tol=3e-4)


def at(s):
    return dt.datetime.fromisoformat(s)


def test_nearest_tolerance_and_ties(spark):
    from millrace.operators.asof import nearest
    from pyspark.sql import functions as F

    left = spark.createDataFrame([(1, "a", at("2024-01-01 10:00")), (2, "a", at("2024-01-01 12:00")), (3, "b", at("2024-01-01 10:00")), (4, None, at("2024-01-01 10:00"))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", at("2024-01-01 09:30"), 1.0), ("a", at("2024-01-01 10:30"), 2.0), ("a", at("2024-01-01 13:01"), 3.0)], "k string, ts timestamp, v double")
    got = {r.id: r.v for r in nearest(left, right, "k", "t", "ts", "v", ["id"], F.lit(3_600_000_000), 3_600_000_000).collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: None}


def test_last_before_carries_over_buckets(spark):
    from millrace.operators.asof import last_before

    left = spark.createDataFrame([(1, "a", at("2024-01-05 10:00")), (2, "a", at("2023-12-31 10:00")), (3, "a", at("2024-01-01 09:00"))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", at("2024-01-01 09:00"), 1.0, 1), ("a", at("2024-01-01 09:00"), 2.0, 2), ("a", at("2024-01-02 09:00"), None, 3)], "k string, ts timestamp, v double, o int")
    got = {r.id: r.v for r in last_before(left, right, "k", "t", "ts", "v", "o").collect()}
    assert got == {1: None, 2: None, 3: 2.0}


def test_weeks_end_on_sunday_and_spines_have_no_gaps(spark):
    from millrace.operators.calendar import spine, week_end
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 1, 8),), (dt.date(2024, 1, 29),)], "d date")
    assert [r.w for r in df.select(week_end(F.col("d")).alias("w")).collect()] == [dt.date(2024, 1, 7), dt.date(2024, 1, 14), dt.date(2024, 2, 4)]
    assert spine(df, "d", "W").count() == 5
    assert spine(df.limit(0), "d", "W").count() == 0


def test_trading_numbers(spark):
    from millrace.functions.text import trading_date, trading_number
    from pyspark.sql import functions as F

    rows = [("1,234.5K", 1234500.0), ("4.5M", 4.5e6), ("1.2B", 1.2e9), ("12%", 12.0), ("", None), ("N/A", None), ("45k", None), (None, None)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "i int, s string")
    assert [r.v for r in df.select("i", trading_number(F.col("s")).alias("v")).orderBy("i").collect()] == [v for _, v in rows]
    d = spark.createDataFrame([("\ufeff03-08-2025",), ("2025-08-03",), ("x",)], "s string")
    assert [r.v for r in d.select(trading_date(F.col("s")).alias("v")).collect()] == [dt.date(2025, 8, 3)] * 2 + [None]


def test_noise_sections(spark):
    from millrace.functions.text import without_noise
    from pyspark.sql import functions as F

    t = "keep\nDisclaimer\nlegal\n\nafter\nAUTHOR(S)\nname\n----\nend"
    assert spark.range(1).select(without_noise(F.lit(t)).alias("t")).first().t == "keep\nafter\nend"


def test_alert_limits():
    from millrace.plans.scores import alert_step

    state = {"hour": -1, "sent": 0, "last": {}}
    row = lambda t, s: {"asset": "a", "event_id": t, "signature": s, "t": t}
    assert alert_step(state, row(0, "x"))["sent"]
    assert not alert_step(state, row(299, "x"))["sent"]
    assert alert_step(state, row(300, "x"))["sent"]
    sent = [alert_step(state, row(400 + i, f"s{i}"))["sent"] for i in range(12)]
    assert sent == [True] * 8 + [False] * 4
    assert alert_step(state, row(3600, "new hour"))["sent"]


def test_backtest_closes_everything(spark):
    from millrace.operators.simulate import LongCall, backtest

    days = [("x", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1000.0 + 10 * i, 20.0, "low", 1.0) for i in range(60)]
    df = spark.createDataFrame(days, "asset string, date date, close double, volatility double, vol_regime string, distance_to_support double")
    t = backtest(df, {"p": LongCall(days=30, target=1e9, stop=-1e9)}).collect()
    assert all(r.exit_date > r.entry_date or r.exit_date == dt.date(2024, 2, 29) for r in t)
    assert max(r.exit_date for r in t) == dt.date(2024, 2, 29)
    assert all((r.exit_date - r.entry_date).days <= 23 for r in t)
    assert LongCall().jittered(5) == LongCall().jittered(5)


def test_files(spark, tmp_path):
    from millrace.sources import readers, writers
    from pyspark.sql import functions as F

    (tmp_path / "v.csv").write_text('"Date","Price","Open","High","Low","Vol.","Change %"\n"03-08-2025","43,210.5","43,000","44,000","42,000","12.3K","-1.2%"\n"bad","","","","","",""\n')
    r = readers.vendor_prices(spark, f"file://{tmp_path}/v.csv", "BTC").collect()
    assert [(x.date, x.close, x.volume) for x in r] == [(dt.date(2025, 8, 3), 43210.5, 12300.0)]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>u</link><pubDate>Sun, 3 Aug 2025 20:48:34 +0000</pubDate></item><item><title>B</title><link>u</link></item></channel></rss>")
    assert [x.link for x in readers.feed_items(spark, f"file://{tmp_path}/feed.xml").collect()] == ["u"]
    assert readers.files(spark, f"file://{tmp_path}", "*.csv").count() == 1
    df = spark.createDataFrame([(1, 2.0, 3.0, "C:\\Users\\me\\x")], "b int, BTC_ret_24h double, a double, p string")
    writers.ordered_csv(df, f"file://{tmp_path}/out", ["b", "none"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").columns == ["b", "BTC_ret_24h", "a", "p"]
    assert writers.packed(df, "_ret_", "returns", ["b"]).first().returns == '{"BTC_ret_24h":2.0}'
    assert df.select(writers.sanitized(F.col("p")).alias("p")).first().p == "x"
