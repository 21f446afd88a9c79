"""Writers: merged tables, partitioned price files, flattened summaries, and redacted results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.dedupe import latest


def merged(target: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """target after incoming has been upserted: for each key the row with the largest `order`, incoming's on a tie."""
    both = target.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [order, "_new"]).drop("_new")


def upsert(incoming: DataFrame, path: str, keys: list[str], order: str, into: str) -> None:
    """Write what `merged` makes of the table at path to a new place; readers switch over when it is whole."""
    merged(incoming.sparkSession.read.parquet(path), incoming, keys, order).write.parquet(into)


def price_files(prices: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Prices partitioned by asset; only the assets at hand are overwritten."""
    w = prices.write.mode("overwrite").partitionBy("asset").option("partitionOverwriteMode", "dynamic")
    (w.option("header", True).csv if fmt == "csv" else w.parquet)(path)


def price_summary(prices: DataFrame) -> DataFrame:
    return prices.groupBy("asset").agg(F.count("*").alias("rows"), F.min("close").alias("least"), F.max("close").alias("most"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("sd"), F.min("date").alias("first"), F.max("date").alias("last"))


def ordered_csv(df: DataFrame, path: str, first: list[str]) -> None:
    """CSV with the preferred columns first, those that exist, then the others by name."""
    cols = [c for c in first if c in df.columns]
    df.select(*cols, *sorted(c for c in df.columns if c not in cols)).write.option("header", True).csv(path)


def packed(df: DataFrame, part: str, name: str, keep: list[str]) -> DataFrame:
    """keep, and one JSON column of all columns whose name has `part` in it."""
    return df.select(*keep, F.to_json(F.struct(*sorted(c for c in df.columns if part in c))).alias(name))


def sanitized(path: Column) -> Column:
    """A path without home folders, drive letters and user names."""
    out = F.regexp_replace(path, r"^[A-Za-z]:", "")
    out = F.regexp_replace(F.replace(out, F.lit("\\"), F.lit("/")), r"^/(?:home|Users)/[^/]+", "")
    return F.regexp_replace(out, r"^/+", "")
