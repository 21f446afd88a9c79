"""Intermediate tables in the shared folder, narrowing by key, joins with hot keys, and connected components over links."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import fresh


_made: ContextVar[tuple[str, ...]] = ContextVar("made", default=())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and lost executors lose nothing of it."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    _made.set((*_made.get(), path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing will read again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, path)


def distilled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows as a written table; all tables that it wrote on the way are deleted."""
    before = _made.get()
    out = written(make(), name)
    for path in _made.get()[len(before) : -1]:
        _delete(out.sparkSession, path)
    _made.set((*before, _made.get()[-1]))
    return out


#: Bits of the map that narrows a table, whatever the number of keys: 8 MB are broadcast at most.
MAP_BITS = 1 << 26


def _may_be_among(key: Callable[[str], Column], keys: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """A bitmap of the keys' hashes in at most MAP_BITS / 32768 rows, and the condition that a row's key is on it."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS)) + 1
    at = place(F.col(name))
    bits = keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    bit = F.bitmap_bit_position(place(key(name)))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return bits, (F.bitmap_bucket_number(place(key(name))) == F.col("_bucket")) & (F.getbit(byte, (bit % 8).cast("int")) == 1)


def narrowed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key may be among keys: all that are, and the few others whose hash falls on the same bit.

    One plan at every size: a bitmap of at most 8 MB is broadcast, and the join that follows is exact.  With more keys than
    bits the map fills and rows pass to that join, which shuffles them.
    """
    bits, on_map = _may_be_among(lambda c: df[c], keys, key)
    return df.join(F.broadcast(bits), on_map, "left_semi")


def surely_without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key's bit isn't on the keys' bitmap: none is among keys, and few others are left out.  Nothing is shuffled."""
    bits, on_map = _may_be_among(lambda c: df[c], keys, key)
    return df.join(F.broadcast(bits), on_map, "left_anti")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is not among keys; null keys stay.  Only rows that the bitmap can't tell apart are shuffled."""
    bits, on_map = _may_be_among(lambda c: df[c], keys, key)
    return df.join(F.broadcast(bits), on_map, "left_anti").unionByName(narrowed(df, keys, key).join(keys, key, "left_anti"))


#: Most keys that are joined by broadcast, those that occur most; every other key has at most LEAST_HOT rows or a share of 1 / HOT_KEYS.
HOT_KEYS, LEAST_HOT = 50_000, 2_000


def by_key(rows: DataFrame, stats: DataFrame, on: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with one row per key, inner or left; stats has the key's number of rows in n and should be a written table.

    A key is hot if it has more than LEAST_HOT rows and more than 1 / HOT_KEYS of all: that bounds the number of hot keys,
    which are broadcast, so that no task gets all rows of one.  The others are joined by a shuffle.
    """
    total = stats.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.broadcast(stats.where(F.col(n) > max(LEAST_HOT, total // HOT_KEYS)))
    cold = stats.where(F.col(n) <= max(LEAST_HOT, total // HOT_KEYS))
    rest = rows.join(hot.select(*on), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(cold, on, how))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for every id in a link; component_id is the smallest id that links reach.

    Alternating large-star and small-star steps; each is joins and min() over all links, and the table after each pair
    of steps goes to the shared folder.  Ids with very many links are joined by broadcast.  Null ends and loops are
    ignored; an empty table gives no rows.
    """
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        if edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty():
            twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
            if twice:
                break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = by_key(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        small_least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = by_key(large, small_least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        done, edges = edges, written(small, "edges")
        dropped(done, least, large, small_least)
    pairs = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return pairs.unionByName(pairs.select(F.col("component_id").alias("id"), "component_id").distinct())
