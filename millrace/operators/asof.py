"""Joins by time: nearest within a tolerance, last before, and windows ahead.

Each is an equi-join on the key and a time bucket, so that a key with many rows is worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """A timestamp, with or without zone (then UTC), as microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, value: str, row: list[str], tolerance_us: Column, most_us: int, tie: str | None = None, within: tuple[Column, Column] | None = None) -> DataFrame:
    """For each left row, the value of the right row with its key whose ts is nearest to `at`, within tolerance_us.

    row: left columns that identify a row; they come back with `value`, null where nothing is near enough.  most_us is at
    least any row's tolerance and sets the bucket size.  Ties: the earlier ts, then the smaller `tie`.  A null key or time
    matches nothing.  within: the first and last microsecond, columns of left, that a right row may have besides, `at`
    among them.  Both sides are sorted together within key and bucket, and only each row's neighbours before and after
    are looked at, so the work grows with the rows and not with their pairs.
    """
    cols = [f"_r{i}" for i in range(len(row))]
    ends = [micros(F.col(at)) - tolerance_us, micros(F.col(at)) + tolerance_us]
    if within:
        ends = [F.greatest(ends[0], within[0]), F.least(ends[1], within[1])]
    l = left.select(F.col(key).alias("_key"), micros(F.col(at)).alias("_t"), *[c.alias(n) for c, n in zip(ends, ("_from", "_to"), strict=True)], *[F.col(c).alias(n) for c, n in zip(row, cols, strict=True)]).distinct()
    l = l.withColumn("_bucket", F.explode_outer(F.sequence(F.floor(F.col("_from") / most_us), F.floor(F.col("_to") / most_us))))
    r = right.select(F.col(key).alias("_key"), micros(F.col(ts)).alias("_t"), F.col(value).alias("_v"), (F.col(tie) if tie else F.lit(0)).alias("_tie")).where("_key IS NOT NULL AND _t IS NOT NULL")
    r = r.groupBy("_key", "_t").agg(F.min_by(F.struct("_t", "_v"), "_tie").alias("_right")).withColumn("_bucket", F.floor(F.col("_t") / most_us))
    both = l.withColumn("_is_left", F.lit(True)).unionByName(r.withColumn("_is_left", F.lit(False)), allowMissingColumns=True)
    inside = W.partitionBy("_key", "_bucket")
    before = F.last("_right", ignorenulls=True).over(inside.orderBy("_t", "_is_left").rowsBetween(W.unboundedPreceding, 0))
    after = F.last("_right", ignorenulls=True).over(inside.orderBy(F.desc("_t"), F.desc("_is_left")).rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumns({"_before": before, "_after": after}).where("_is_left")
    near = found.withColumn("_near", F.explode_outer(F.filter(F.array("_before", "_after"), lambda x: x["_t"].between(F.col("_from"), F.col("_to")))))
    best = near.groupBy(*cols).agg(F.min_by("_near._v", F.when(F.col("_near").isNotNull(), F.struct(F.abs(F.col("_near._t") - F.col("_t")), F.col("_near._t")))).alias(value))
    return best.select(*[F.col(n).alias(c) for c, n in zip(row, cols, strict=True)], value)


def last_before(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, value: str, order: str, bucket_us: int = 86_400_000_000) -> DataFrame:
    """Each left row with the value of the last right row with its key at or before `at`; null if there is none.

    order breaks ties among right rows of one time: the largest wins.  Rows are worked on by key and time bucket; the last
    value of each bucket is carried into the next ones.
    """
    cols = left.columns
    r = right.select(F.col(key), micros(F.col(ts)).alias("_t"), F.struct(F.col(value).alias("v")).alias("_v"), F.col(order).cast("long").alias("_o"), F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in cols])
    l = left.select(F.col(key), micros(F.col(at)).alias("_t"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.lit(None).cast("long").alias("_o"), F.lit(1).alias("_side"), *[F.col(c).alias(f"_l_{c}") for c in cols])
    both = r.unionByName(l).withColumn("_b", F.floor(F.col("_t") / bucket_us))
    ends = both.where("_side = 0").groupBy(key, "_b").agg(F.max_by("_v", F.struct("_t", "_o")).alias("_end"))
    days = both.select(key, "_b").distinct().join(ends, [key, "_b"], "left")
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = days.select(key, "_b", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inside = W.partitionBy(key, "_b").orderBy("_t", "_side", "_o").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    found = found.join(carried, [key, "_b"], "left")
    return found.select(*[F.col(f"_l_{c}").alias(c) for c in cols], F.coalesce("_last", "_carry")["v"].alias(value))


def ahead(left: DataFrame, prices: DataFrame, key: str, start: str, days: Column, most_days: int) -> DataFrame:
    """Left rows joined with the price rows of their key whose date is in [start, start + days]; both must be dates.

    prices' columns come back under a leading "p_".
    """
    epoch = F.lit("1970-01-01").cast("date")
    bucket = lambda d: F.floor(F.datediff(d, epoch) / most_days)
    l = left.withColumn("_days", days).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.date_add(F.col(start), F.col("_days"))))))
    p = prices.select(*[F.col(c).alias(f"p_{c}") for c in prices.columns]).withColumn("_in", bucket(F.col("p_date")))
    on = (F.col(key) == F.col(f"p_{key}")) & (F.col("_bucket") == F.col("_in")) & F.col("p_date").between(F.col(start), F.date_add(F.col(start), F.col("_days")))
    return l.join(p, on).drop("_bucket", "_in", "_days", f"p_{key}")
