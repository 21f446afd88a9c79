"""Readers with fixed schemas: articles in nested JSON, vendor price files, files as rows, and the newest of several."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import trading_date, trading_number

ARTICLES = """unified_articles ARRAY<STRUCT<title STRING, publication_date STRING, readable_date STRING, slug STRING,
  classification STRUCT<primary_theme STRING, article_type STRING, assets_mentioned ARRAY<STRING>, complexity_score DOUBLE>,
  trading_signals STRUCT<primary_action STRING, signal_strength DOUBLE, directional_bias STRING, risk_level STRING>,
  market_context STRUCT<market_period STRING, time_sensitivity STRING, event_driven BOOLEAN>, extraction_confidence DOUBLE,
  content_analysis STRUCT<word_count INT, technical_density DOUBLE, sentiment_indicators STRUCT<bullish INT, bearish INT, uncertain INT, volatile INT>>,
  analyzed_images ARRAY<STRING>, body_text STRING, data_sources ARRAY<STRING>>>"""
VENDOR = "`Date` STRING, `Price` STRING, `Open` STRING, `High` STRING, `Low` STRING, `Vol.` STRING, `Change %` STRING"


def articles_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per article of unified JSON files, nested fields flattened, with defaults for what is missing.

    lines: each line of a file is such an object, so that large files are split.  What isn't such JSON gives no rows.
    """
    raw = spark.read.schema(f"{ARTICLES}, _bad STRING").option("multiLine", not lines).option("columnNameOfCorruptRecord", "_bad").json(path)
    a = raw.select(F.explode("unified_articles").alias("a"))
    text = lambda c, d="unknown": F.coalesce(F.col(f"a.{c}"), F.lit(d))
    number = lambda c: F.coalesce(F.col(f"a.{c}").cast("double"), F.lit(0.0))
    mood = "content_analysis.sentiment_indicators"
    return a.select(
        text("title", "").alias("title"),
        F.coalesce(F.try_to_timestamp(F.col("a.publication_date")), F.lit("2022-01-01").cast("timestamp")).alias("date"),
        text("readable_date", "").alias("readable_date"),
        text("slug", "").alias("slug"),
        text("classification.primary_theme").alias("primary_theme"),
        text("classification.article_type").alias("article_type"),
        F.coalesce(F.col("a.classification.assets_mentioned"), F.array().cast("array<string>")).alias("assets_mentioned"),
        number("classification.complexity_score").alias("complexity_score"),
        text("trading_signals.primary_action").alias("primary_action"),
        number("trading_signals.signal_strength").alias("signal_strength"),
        text("trading_signals.directional_bias", "neutral").alias("directional_bias"),
        text("trading_signals.risk_level").alias("risk_level"),
        text("market_context.market_period").alias("market_period"),
        text("market_context.time_sensitivity").alias("time_sensitivity"),
        F.coalesce(F.col("a.market_context.event_driven"), F.lit(False)).alias("event_driven"),
        number("extraction_confidence").alias("extraction_confidence"),
        number("content_analysis.word_count").cast("int").alias("word_count"),
        number("content_analysis.technical_density").alias("technical_density"),
        *[number(f"{mood}.{k}").cast("int").alias(f"sentiment_{k}") for k in ("bullish", "bearish", "uncertain", "volatile")],
        F.coalesce(F.size("a.analyzed_images"), F.lit(0)).alias("num_images"),
        (F.coalesce(F.col("a.body_text"), F.lit("")) != "").alias("has_body_text"),
        F.coalesce(F.col("a.data_sources"), F.array().cast("array<string>")).alias("data_sources"),
    )


def vendor_prices(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """(asset, date, open, high, low, close, volume) of a vendor's price export; rows without a date go."""
    raw = spark.read.schema(VENDOR).option("header", True).csv(path)
    n = trading_number
    return raw.select(F.lit(asset).alias("asset"), trading_date(F.col("Date")).alias("date"), n(F.col("Open")).alias("open"), n(F.col("High")).alias("high"), n(F.col("Low")).alias("low"), n(F.col("Price")).alias("close"), n(F.col("`Vol.`")).alias("volume")).where("date IS NOT NULL")


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, published) of RSS files, each link once: its smallest title."""
    raw = spark.read.schema("title STRING, link STRING, pubDate STRING").format("xml").option("rowTag", "item").load(path)
    return raw.where("link IS NOT NULL").groupBy("link").agg(F.min(F.struct("title", "pubDate")).alias("x")).select("x.title", "link", F.try_to_timestamp(F.regexp_replace("x.pubDate", "^[A-Za-z]+, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified, sha256) of the files below path whose names match."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return raw.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def newest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the JSON file below path that was modified last; of two at one time, the one with the larger name."""
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_file"))
    last = rows.agg(F.max(F.struct("_at", "_file")).alias("_last"))
    return rows.join(F.broadcast(last), F.struct("_at", "_file") == F.col("_last")).drop("_at", "_file", "_last")


def first_with_rows(*sources: DataFrame) -> DataFrame:
    """The first source that has rows, else the last."""
    for s in sources[:-1]:
        if not s.isEmpty():
            return s
    return sources[-1]
