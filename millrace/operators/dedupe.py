"""One record per key: the latest, the first, or the best by a fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.simulate import fold_to_one


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest order for each key: what merging the rows in order leaves.  An aggregate, so keys of any size are fine."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def first_by_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """df with first_id, the smallest `order` of its content, and is_duplicate for all others."""
    first = df.groupBy(content).agg(F.min(order).alias("first_id"))
    return df.join(first, content).select(order, content, "first_id", (F.col(order) > F.col("first_id")).alias("is_duplicate"))


def best_of(df: DataFrame, key: str, order: str, measures: list[str]) -> DataFrame:
    """Fold each key's rows in order: a row replaces the kept one if any measure is larger.  (A ranking can't say this.)

    Nulls count as smaller than anything.  Only the key, order and measures are moved, and a key's rows are streamed.
    """

    def step(kept: dict | None, row: dict) -> dict:
        better = kept is None or any(row[m] is not None and (kept[m] is None or row[m] > kept[m]) for m in measures)
        return row if better else kept

    return fold_to_one(df.select(key, order, *measures), key, [order], step)


def keep_last(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n rows with the largest order of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def replace_children(children: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """children after those of incoming's parents have been deleted and incoming inserted."""
    return children.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming, allowMissingColumns=True)
