"""Mixing sources to target weights by Pfair scheduling.  DataFrame functions only.

Each source's documents, in order of id, make blocks of about `block_chars`.  With weight q of P parts, block j of a source
may not run before slot floor(j * P / q), its release, and must run by slot ceil((j + 1) * P / q), its deadline; in every
slot the released block with the earliest deadline runs.  The weights sum to one, so every deadline is met, and after any
number of slots each source is less than one block from its share.  After P slots the schedule repeats: one period is worked
out, and every block finds its slot by its number, all in parallel.

A source that has run out of blocks leaves: its slots stay empty and are passed over, so the others keep their weights
among themselves and its share goes to them in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_CHARS = 100_000
#: Parts that the weights are rounded down to, at least one each; more sources than that can't be told apart.
PARTS = 1_000
#: A source's default weight is its size to this power: large sources give way to small ones a little.
POWER = 0.9
#: Ids whose running sizes one task works out.
IDS = 4_096


def quotas(sizes: DataFrame, parts: int = PARTS, power: float = POWER, weights: DataFrame | None = None) -> DataFrame:
    """(source, q): each source's slots in a period of sum(q) slots.

    sizes: (source, chars).  weights: (source, weight), if given; sources without one, or with none above zero, have one slot.
    """
    if weights is None:
        shares = sizes.select("source", F.pow(F.col("chars").cast("double"), F.lit(power)).alias("share"))
    else:
        given = weights.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.max("weight").alias("share"))
        shares = sizes.join(given, "source", "left").select("source", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)).alias("share"))
    total = shares.agg(F.sum(F.round("share", 6)).alias("total"))
    part = F.floor(F.try_divide(F.col("share") * parts, F.col("total")) + 1e-9)
    return shares.join(F.broadcast(total)).select("source", F.greatest(F.lit(1), F.coalesce(part, F.lit(1))).cast("long").alias("q"))


def period(quota: DataFrame) -> DataFrame:
    """(source, q, n, nth, slot): the slot of each source's nth block in a period of n slots.

    The sources come together in one row here; their number is bounded by PARTS.
    """
    one = quota.agg(F.sort_array(F.collect_list(F.struct("source", "q"))).alias("s"), F.sum("q").alias("n"))
    step = """
      aggregate(sequence(0L, n - 1),
        named_struct('c', transform(s, x -> 0L), 'o', cast(array() AS array<int>)),
        (a, t) -> transform(array(array_min(filter(
            transform(s, (x, i) -> named_struct('d', ((a.c[i] + 1) * n + x.q - 1) div x.q, 'i', i, 'r', (a.c[i] * n) div x.q)), y -> y.r <= t))),
          b -> named_struct('c', transform(a.c, (k, i) -> if(i = b.i, k + 1, k)), 'o', a.o || array(b.i)))[0],
        a -> a.o)"""
    slots = one.where("n > 0").withColumn("o", F.expr(step)).select("s", "n", F.posexplode("o").alias("slot", "i"))
    named = slots.select(F.get("s", F.col("i")).alias("x"), "n", F.col("slot").cast("long").alias("slot"))
    nth = F.row_number().over(W.partitionBy("x.source").orderBy("slot")) - 1
    return named.select("x.source", "x.q", "n", nth.cast("long").alias("nth"), "slot")


def mix(docs: DataFrame, block_chars: int = BLOCK_CHARS, parts: int = PARTS, power: float = POWER, weights: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """One row per input row (doc_id, text, source): doc_id, source, chars, block, slot, in_mix.

    slot: the block's place in the interleaving.  in_mix: whether it stands before the first slot whose source has run
    out of blocks; up to there every slot is filled.  With weights only sources that have one above zero end the mix, and
    with `whole` none does: in_mix is true everywhere.  A document belongs to the
    block in which it starts.  A null source counts as the source ''; a null id comes first; null text has no characters.
    Ties and repeated rows follow one another in order of size.  Extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("chars"))
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("doc_id") / IDS), F.lit(-(1 << 60))))
    # Running sizes in two steps, so that a source of any size is worked on by many tasks.
    runs = rows.groupBy("source", "run").agg(F.sum("chars").alias("n"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select("source", "run", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("chars").over(W.partitionBy("source", "run").orderBy("doc_id", "chars").rowsBetween(W.unboundedPreceding, -1))
    starts = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(runs, ["source", "run"])
    blocks = starts.select("doc_id", "source", "chars", F.expr(f"(before + inside) div {block_chars}").alias("block"))

    sizes = rows.groupBy("source").agg(F.sum("chars").alias("chars"))
    table = period(quotas(sizes, parts, power, weights))
    at = lambda df: df.withColumn("slot", F.expr("(block div q) * n + slot"))
    placed = at(blocks.join(F.broadcast(table.withColumnRenamed("source", "of")), F.expr("source = of AND block % q = nth")))
    # The first block that each source hasn't got: the block after the one in which its text ends.
    missing = sizes.select("source", F.expr(f"(greatest(chars, 1) + {block_chars - 1}) div {block_chars}").alias("block"))
    if whole:
        missing = missing.limit(0)
    elif weights is not None:
        missing = missing.join(weights.where("weight > 0").select(F.coalesce("source", F.lit("")).alias("source")).distinct(), "source", "left_semi")
    missing = at(missing.join(F.broadcast(table.withColumnRenamed("source", "of")), F.expr("source = of AND block % q = nth")))
    ends = missing.agg(F.min("slot").alias("ends"))
    return placed.join(F.broadcast(ends)).select("doc_id", "source", "chars", "block", "slot", F.coalesce(F.col("slot") < F.col("ends"), F.lit(True)).alias("in_mix"))


def sql(block_chars: int = BLOCK_CHARS, parts: int = PARTS, power: float = POWER) -> str:
    """The mix in DuckDB's SQL: running sizes in one window, the period by recursion, slot after slot."""
    return f"""
WITH RECURSIVE rows_ AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, CAST(coalesce(length(text), 0) AS BIGINT) AS chars FROM documents),
blocks AS (
  SELECT doc_id, source, chars, coalesce(sum(chars) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {block_chars} AS block FROM rows_),
sizes AS MATERIALIZED (SELECT source, sum(chars)::BIGINT AS chars FROM rows_ GROUP BY source),
quota AS MATERIALIZED (
  SELECT source, chars, greatest(1, floor(pow(chars::DOUBLE, {power}) * {parts} / sum(round(pow(chars::DOUBLE, {power}), 6)) OVER () + 1e-9))::BIGINT AS q FROM sizes),
one AS MATERIALIZED (SELECT list(source ORDER BY source) AS s, list(q ORDER BY source) AS q, sum(q)::BIGINT AS n FROM quota),
sched AS (
  SELECT -1::BIGINT AS slot, NULL::BIGINT AS i, list_transform(q, lambda x: 0::BIGINT) AS c, NULL::BIGINT AS nth, q, s, n FROM one
  UNION ALL
  SELECT slot + 1, b, list_transform(c, lambda x, k: CASE WHEN k = b THEN x + 1 ELSE x END), c[b], q, s, n FROM (
    SELECT *, list_min(list_filter(list_transform(range(1, len(q) + 1), lambda k: {{'d': ((c[k] + 1) * n + q[k] - 1) // q[k], 'i': k, 'r': (c[k] * n) // q[k]}}), lambda y: y.r <= slot + 1)).i AS b
    FROM sched WHERE slot + 1 < n)),
table_ AS MATERIALIZED (SELECT s[i] AS source, q[i] AS q, n, nth, slot FROM sched WHERE slot >= 0),
ends AS (
  SELECT min((m.block // q) * n + slot) AS ends FROM (SELECT source, (greatest(chars, 1) + {block_chars - 1}) // {block_chars} AS block FROM sizes) m
  JOIN table_ t ON t.source = m.source AND m.block % q = nth)
SELECT doc_id, b.source, chars, block, (block // q) * n + slot AS slot, (block // q) * n + slot < ends AS in_mix
FROM blocks b JOIN table_ t ON t.source = b.source AND block % q = nth, ends
"""
