"""Tables written and read back through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.sources import readers, writers
from millrace.sources.scratch import fresh
from millrace.tables import ARTICLES, DAILY, articles, daily, load


@query(f"WITH {ARTICLES} SELECT CAST(article_id AS VARCHAR) AS title, theme AS primary_theme, bias AS directional_bias, round(signal, 9) AS signal_strength, date, 'unknown' AS risk_level, 2 AS num_images, true AS has_body_text FROM articles")
def articles_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as nested JSON files, read back as the flattened frame."""
    a = articles(spark, sf_dir)
    one = F.struct(
        F.col("article_id").cast("string").alias("title"), F.col("date").cast("string").alias("publication_date"), F.struct(F.col("theme").alias("primary_theme")).alias("classification"),
        F.struct(F.col("signal").alias("signal_strength"), F.col("bias").alias("directional_bias")).alias("trading_signals"), F.array(F.lit("a"), F.lit("b")).alias("analyzed_images"), F.lit("x").alias("body_text"))
    path = fresh(spark, "articles")
    batches = a.withColumn("part", F.floor(F.col("article_id") / 1000)).groupBy("part").agg(F.collect_list(one).alias("unified_articles"))
    batches.select("unified_articles").write.json(path)
    out = readers.articles_json(spark, path, lines=True)
    return out.select("title", "primary_theme", "directional_bias", F.round("signal_strength", 9).alias("signal_strength"), F.to_date("date").alias("date"), "risk_level", "num_images", "has_body_text")


@query(f"WITH {DAILY} SELECT asset, count(*) AS rows, min(close) AS least, max(close) AS most, round(avg(close), 4) AS mean, round(stddev_samp(close), 4) AS sd, min(date) AS first, max(date) AS last FROM daily GROUP BY 1")
def price_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "prices")
    writers.price_files(daily(spark, sf_dir), path)
    out = writers.price_summary(spark.read.parquet(path))
    return out.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query("SELECT c_custkey, coalesce(e.event_type, 'none') AS state FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) e ON e.user_id = c_custkey")
def merge_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' states after the events were merged in."""
    target = load(spark, sf_dir, "customer").select("c_custkey", F.lit("none").alias("state"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("id"))
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("state"), "ts", F.col("event_id").alias("id"))
    incoming = e.join(target.select("c_custkey"), "c_custkey", "left_semi")
    return writers.merged(target.withColumn("order", F.struct("ts", "id")), incoming.withColumn("order", F.struct("ts", "id")), ["c_custkey"], "order").select("c_custkey", "state")
