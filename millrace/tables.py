"""The tables as the market operators see them: ticks, daily prices and articles, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ts, price, user_id, event_id): events as price points; one is added so that ratios are defined."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("asset"), "ts", (F.col("value") + 1.0).alias("price"), "user_id", "event_id")


TICKS = "ticks AS (SELECT event_type AS asset, ts, value + 1.0 AS price, user_id, event_id FROM events)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, open, high, low, close, volume): orders as daily prices, one asset per priority."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


DAILY = """daily AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open,
  max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, asset, date, theme, bias, signal, confidence): orders as articles on one asset."""
    o = load(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("article_id"),
        F.col("o_orderpriority").alias("asset"),
        F.to_date("o_orderdate").alias("date"),
        F.concat(F.lit("theme"), (F.col("o_custkey") % 6).cast("string")).alias("theme"),
        F.when(status == "F", "bullish").when(status == "O", "bearish").otherwise("neutral").alias("bias"),
        (F.col("o_totalprice") / 500000.0).alias("signal"),
        ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"),
    )


ARTICLES = """articles AS (SELECT o_orderkey AS article_id, o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date,
  'theme' || CAST(o_custkey % 6 AS VARCHAR) AS theme,
  CASE o_orderstatus WHEN 'F' THEN 'bullish' WHEN 'O' THEN 'bearish' ELSE 'neutral' END AS bias,
  o_totalprice / 500000.0 AS signal, (o_orderkey % 100) / 100.0 AS confidence FROM orders)"""
