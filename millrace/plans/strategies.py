"""Strategies given in SQL, over the daily contexts of every asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.strategies import register
from millrace.plans.registry import query
from millrace.plans.scores import contexts

CALLS = {
    "call": "strategy => 'long_call', target => 50000.0, stop => -20000.0",
    "short_call": "strategy => 'long_call', days => 14, target => 20000.0, stop => -10000.0",
    "put": "strategy => 'long_put', target => 40000.0, stop => -20000.0",
}


@query()
def backtest_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of two calls and a put on every asset, each by one call of the table function."""
    register(spark, "backtest")
    contexts(spark, sf_dir).createOrReplaceTempView("backtest_contexts")
    one = lambda name, args: f"SELECT '{name}' AS params, t.* FROM backtest(TABLE(backtest_contexts) PARTITION BY asset ORDER BY date, {args}) t"
    return spark.sql(" UNION ALL ".join(one(*c) for c in CALLS.items()))
