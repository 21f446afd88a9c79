"""Running values over a key's rows in order of time, worked on day by day: each day's own part in parallel, and what days before it add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.scratch import kept

DAY = ("asset", "day")


def inside(*order: str):
    """A key's day in order."""
    return W.partitionBy(*DAY).orderBy(*order)


def before():
    """A key's days before this one: a row for each day."""
    return W.partitionBy("asset").orderBy("day").rowsBetween(W.unboundedPreceding, -1)


def with_days(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("day", F.to_date(ts))


def with_carry(df: DataFrame, of_day: list[Column], carried: dict[str, Column]) -> DataFrame:
    """df with columns carried into each day: of_day are aggregates of a day, `carried` expressions over before() on them.  Null keys and days are ones like others."""
    days = df.groupBy(*DAY).agg(*of_day).select(*[F.col(c).alias(f"_{c}") for c in DAY], *[c.alias(k) for k, c in carried.items()])
    return df.join(days, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DAY]).drop(*[f"_{c}" for c in DAY])


#: Rows of one range, about, where rows are numbered.
RANGE_ROWS = 500_000


def numbered(df: DataFrame, shard: Column, order: str, name: str) -> DataFrame:
    """df with `name`, each row's number from 1 in its shard by `order`, which must be distinct and not null.

    Rows are numbered within ranges of `order` that a sketch makes about equal, and each range then adds the counts of those below it, so
    a shard of any size is numbered by many tasks.  Where the ranges end makes no difference to the numbers.
    """
    n = df.count()
    ps = [i / k for k in [max(1, min(10_000, n // RANGE_ROWS))] for i in range(1, k)]
    ends = df.agg(F.percentile_approx(order, ps, 100 * (len(ps) + 1)).alias("p")).first().p if ps else []
    x = df.withColumns({"_shard": shard, "_range": F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col(order))) if ends else F.lit(0)})
    counts = x.groupBy("_shard", "_range").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("_shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_shard").alias("_s"), F.col("_range").alias("_r"), before.alias("_before"))
    x = x.join(counts, F.col("_shard").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    place = F.row_number().over(W.partitionBy("_shard", "_range").orderBy(order)) + F.col("_before")
    return x.withColumn(name, place.cast("long")).drop("_shard", "_range", "_s", "_r", "_before")


#: Rank error of the first bounds, as a share of a key's rows, is 1 / ACCURACY; splitters of what lies between them.
ACCURACY, SPLITTERS = 10_000, 100


def quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float], bins: int = SPLITTERS) -> DataFrame:
    """Exact interpolated quantiles of each key; no key's values, and no range of them, come together in one task.

    1. A sketch of each key bounds each wanted rank by two values that at most 4 / ACCURACY of the key's rows lie between.
    2. Rows below the bounds are counted, those between are grouped by value, so repeated values are one row.
    3. Of these, splitters (again from a sketch) make up to `bins` bins; those with a wanted rank, and only they, are sorted.
    Bounds that miss their rank are replaced by the key's least and largest value, so the sketches decide the cost and not the result.
    How the values are spread plays no part.  Null values and null keys don't count; a key without values has no row.
    """
    names = list(shares)
    base = kept(df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v")), "values")
    ps = [min(1.0, max(0.0, q + d * 2 / ACCURACY)) for q in shares.values() for d in (-1, 1)]
    # A sketch's answer depends on the order in which its parts arrive, so each is written once: no step may see another's bounds or bins.
    bounds = kept(base.groupBy("_k").agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", ps, ACCURACY).alias("_p")), "bounds")
    counts = [f(F.col("_v"), i).alias(f"_{w}{i}") for i in range(len(names)) for w, f in (("b", lambda v, i: F.count_if(v < F.get("_p", 2 * i))), ("i", lambda v, i: F.count_if(v.between(F.get("_p", 2 * i), F.get("_p", 2 * i + 1)))))]
    first = base.join(bounds.select("_k", "_p"), "_k").groupBy("_k").agg(*counts).join(bounds, "_k")
    wanted = []
    for i, q in enumerate(shares.values()):
        at = F.lit(q) * (F.col("_n") - 1)
        low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
        ok = (F.col(f"_b{i}") <= low) & (high < F.col(f"_b{i}") + F.col(f"_i{i}"))
        wanted.append(F.struct(F.lit(i).alias("q"), at.alias("at"), low.alias("low"), high.alias("high"), F.when(ok, F.col(f"_b{i}")).otherwise(0).alias("before"), F.when(ok, F.get("_p", 2 * i)).otherwise(F.col("_min")).alias("lo"), F.when(ok, F.get("_p", 2 * i + 1)).otherwise(F.col("_max")).alias("hi")))
    wanted = kept(first.select("_k", F.array(*wanted).alias("_w")), "wanted")
    near = base.join(wanted, "_k").select("_k", "_v", F.explode(F.filter("_w", lambda w: F.col("_v").between(w["lo"], w["hi"]))).alias("w"))
    by = ["_k", "_q"]
    counted = near.groupBy("_k", F.col("w.q").alias("_q"), "_v").agg(F.count("*").alias("_c"))
    splitters = counted.groupBy(*by).agg(F.percentile_approx("_v", [j / bins for j in range(1, bins)], 10 * bins).alias("_s"))
    binned = kept(counted.join(splitters, by).withColumn("_bin", F.size(F.filter("_s", lambda s: s < F.col("_v")))).drop("_s"), "binned")
    asked = wanted.select("_k", F.explode("_w").alias("w")).select("_k", F.col("w.q").alias("_q"), "w.at", "w.low", "w.high", "w.before")
    running = lambda *parts: F.coalesce(F.sum("_c").over(W.partitionBy(*by, *parts[:-1]).orderBy(parts[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = binned.groupBy(*by, "_bin").agg(F.sum("_c").alias("_c")).withColumn("_below", running("_bin")).join(asked, by).withColumn("_below", F.col("_below") + F.col("before"))
    holds = lambda a, n: ((F.col("low") >= a) & (F.col("low") < a + n)) | ((F.col("high") >= a) & (F.col("high") < a + n))
    held = held.where(holds(F.col("_below"), F.col("_c"))).drop("_c", "before")
    rows = binned.join(held, [*by, "_bin"]).withColumn("_below", F.col("_below") + running("_bin", "_v")).where(holds(F.col("_below"), F.col("_c")))
    has = lambda rank: F.max(F.when((F.col(rank) >= F.col("_below")) & (F.col(rank) < F.col("_below") + F.col("_c")), F.col("_v")))
    ends = rows.groupBy(*by).agg(has("low").alias("a"), has("high").alias("b"), F.max(F.col("at") - F.col("low")).alias("f")).withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))
    return ends.groupBy(F.col("_k").alias(key)).agg(*[F.max(F.when(F.col("_q") == i, F.col("x"))).alias(n) for i, n in enumerate(names)])


def cuts(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with exact quantiles of a whole column; no row if it has no values."""
    return quantiles(df.select(F.lit(0).alias("_all"), value), "_all", value, shares).drop("_all")
