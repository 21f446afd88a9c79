"""The table function: trades of one strategy equal those of the operator, a second one equals a plain loop, wrong calls are refused."""

from collections import defaultdict
from dataclasses import dataclass

import pytest
from pyspark.errors import AnalysisException

from millrace.operators.strategies import Call, Put, register
from millrace.plans.scores import backtest_long_call, contexts
from millrace.plans.strategies import backtest_in_sql

SF = "/root/testdata/sf0.001"


def rounded(rows):
    return sorted((r.asset, r.entry_date, r.exit_date, r.strike, round(r.premium, 4), round(r.pnl, 4)) for r in rows)


def test_trades_in_sql(spark):
    got = defaultdict(list)
    for r in backtest_in_sql(spark, SF).collect():
        got[r.params].append(r)
    want = defaultdict(list)
    for r in backtest_long_call(spark, SF).collect():
        want[r.params].append(r)
    assert rounded(got["call"]) == rounded(want["base"]) and rounded(got["short_call"]) == rounded(want["short"])
    days, puts, s = defaultdict(list), [], Put(target=40000.0, stop=-20000.0)
    for r in contexts(spark, SF).collect():
        days[r.asset].append(r)
    for asset, rows in days.items():
        held = []
        for r in sorted(rows, key=lambda r: r.date):
            for t in list(held):
                left = 30 - (r.date - t[0]).days
                pnl = max(t[1] - r.close, 0) + (r.close * r.volatility / 100 * (left / 365) ** 0.5 * 0.4 if left > 0 else 0) - t[2]
                if pnl >= 40000 or pnl <= -20000 or left <= 7:
                    puts.append((asset, t[0], r.date, t[1], round(t[2], 4), round(pnl, 4)))
                    held.remove(t)
            if len(held) < 3 and r.vol_regime in ("high", "extreme") and r.distance_to_support is not None and r.distance_to_support > 5:
                held.append((r.date, *s.opens(r)))
        puts += [(asset, t[0], r.date, t[1], round(t[2], 4), round(max(t[1] - r.close, 0) + r.close * r.volatility / 100 * ((30 - (r.date - t[0]).days) / 365) ** 0.5 * 0.4 - t[2], 4)) for t in held]
    assert rounded(got["put"]) == sorted(puts) and len(puts) > 10


def test_wrong_calls_are_refused(spark):
    register(spark, "backtest")
    contexts(spark, SF).createOrReplaceTempView("some_days")
    for call in ("TABLE(some_days) PARTITION BY asset ORDER BY date, strategy => 'none'", "TABLE(some_days) PARTITION BY asset ORDER BY date, strategy => 'long_call', height => 3", "TABLE(SELECT asset, date FROM some_days) PARTITION BY asset ORDER BY date, strategy => 'long_call'"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM backtest({call})").collect()


def test_ones_own_strategy_odd_days_and_an_empty_table(spark):
    @dataclass(frozen=True)
    class Always(Call):
        def enters(self, day):
            return True

    register(spark, "own_backtest", {"always": Always})
    spark.sql("""SELECT * FROM VALUES ('x', DATE'2024-01-01', 100D, 10D, CAST(NULL AS STRING), CAST(NULL AS DOUBLE), 1), ('x', DATE'2024-01-03', CAST(NULL AS DOUBLE), 10D, 'low', 1D, 1),
      ('x', DATE'2024-01-02', 120D, 10D, 'low', 1D, 1), (CAST(NULL AS STRING), DATE'2024-01-02', 50D, 10D, 'low', 1D, 1) t(asset, date, close, volatility, vol_regime, distance_to_support, pnl)""").createOrReplaceTempView("odd_days")
    call = "SELECT * FROM own_backtest(TABLE({}) PARTITION BY asset ORDER BY date, strategy => 'always', target => 10, most_open => 1)"
    got = spark.sql(call.format("odd_days")).collect()
    assert sorted((r.asset or "", str(r.entry_date), str(r.exit_date), r.strike) for r in got) == [("", "2024-01-02", "2024-01-02", 50.0), ("x", "2024-01-01", "2024-01-02", 100.0), ("x", "2024-01-02", "2024-01-02", 100.0)]
    assert spark.sql(call.format("SELECT * FROM odd_days WHERE false")).collect() == []
