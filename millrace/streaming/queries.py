"""Event streams: windows with watermarks, de-duplication, and limited alerts with keyed state.

A stream is run over all files at hand (`availableNow`) into a table of the shared folder.  Rows of a window may come more
than once, each time newer: the last of each key counts, so a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.dedupe import latest
from millrace.plans.registry import query
from millrace.sources.scratch import fresh
from millrace.streaming.alerts import ROCKSDB, limited

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, sf_dir: str, delay: str = "10 minutes") -> DataFrame:
    """The events as a stream, with a watermark."""
    files = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/event*.parquet")
    return files.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def drained(stream: DataFrame, keys: list[str] | None, mode: str = "update", at: str | None = None) -> DataFrame:
    """Run a stream over what there is; the last row of each key, or all rows.  at: the progress of an earlier run, to go on from."""
    spark = stream.sparkSession
    path, at = fresh(spark, "stream"), at or fresh(spark, "stream-state")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark.conf.set(provider, ROCKSDB)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    out = spark.read.schema(stream.select("*", F.lit(0).alias("_batch")).schema).option("recursiveFileLookup", True).parquet(path)
    return (latest(out, keys, ["_batch"]) if keys else out).drop("_batch")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
    return drained(rows, ["start", "event_type"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, count(*) AS n FROM events, range(0, 6) r(k) GROUP BY 1")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events(spark, sf_dir).groupBy(F.window("ts", "6 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return drained(w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), ["start"])


@query("""WITH g AS (SELECT user_id, ts, event_id, coalesce(ts >= lag(ts) OVER w + INTERVAL 2 HOUR, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that two hours without an event end; the batch form of the stream operator."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def first_of_day(events: DataFrame) -> DataFrame:
    """Each user's first row of a type and day, from a stream with a watermark on ts.

    A key is kept until the watermark has passed its first row by the watermark's delay: with a day's delay that is as
    long as another row of its day can come, and no longer.
    """
    e = events.select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"), "ts")
    return e.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"])


@query("SELECT DISTINCT user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) AS day FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event of a type and day; later ones are dropped by state that the watermark evicts."""
    e = events(spark, sf_dir, "24 hours")
    return drained(first_of_day(e), None, "append").select("user_id", "event_type", F.col("day").cast("timestamp_ntz").alias("day"))


def alert_stream(events: DataFrame) -> DataFrame:
    return events.where("value > 20").select(F.col("event_type").alias("asset"), "event_id", F.unix_timestamp("ts").alias("t"), F.concat_ws("_", "event_type", F.round(F.col("value") / 50, 1).cast("string")).alias("signature"), "ts")


@query()
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts under the hourly cap and the cool-down, with keyed state that is forgotten after an hour and a day."""
    return drained(limited(alert_stream(events(spark, sf_dir))), None, "append").select("asset", "event_id", "signature", "sent")
