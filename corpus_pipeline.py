"""A training corpus from raw documents: quality rules, near duplicates, repeated passages, source weights, packing.

Each stage takes (spark, docs, sf_dir) and all rows that the one before kept; all but the last return the columns of
documents, whatever further columns those are.  A null text counts as empty, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.jaccard import jaccard_join
from millrace.llm.mixing import mix
from millrace.llm.packing import pack
from millrace.llm.quality import keep
from millrace.llm.repeats import changes, text_without
from millrace.llm.shared import distilled, narrowed, without, written


def unused(docs: DataFrame, name: str) -> str:
    """A column name like this one that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; every row, repeated ones and those without id too, is judged on its own text."""
    return keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group whose five-word shingles are alike at 0.8 or more.

    Of rows with one id, that with the smallest text stays (null first; of equal ones, the smallest other columns).  Rows without id, and texts
    without words, are like nothing and stay.
    """
    classes = distilled(lambda: jaccard_join(docs, n=5, percent=80), "near")
    twice = classes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    docs = without(docs, classes.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id")
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])) if len(docs.columns) > 2 else F.lit("")
    one = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", others)).alias("kept")).select("kept.*")
    return without(docs, twice, "doc_id").unionByName(one)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that 100-byte strings repeat from earlier; those of which nothing is left go.

    Repeated rows of one id are cut alike; rows without id stay as they are, but all their texts count as earlier than all others.
    """
    copies, start, stop = (unused(docs, x) for x in ("copies", "start", "stop"))
    lost = distilled(lambda: changes(docs), "lost").toDF("doc_id", copies, start, stop)
    ids = lost.select("doc_id")
    new = narrowed(docs, ids, "doc_id").hint("merge").join(lost, "doc_id").where(~F.array_contains(copies, F.sha2(F.coalesce("text", F.lit("")), 256)))
    cut = new.where(F.size(start) > 0).withColumn("text", text_without("text", start, stop)).withColumn("n_chars", F.length("text").cast("long"))
    whole = new.where(F.size(start) == 0)
    return without(docs, ids, "doc_id").unionByName(whole.select(*docs.columns)).unionByName(cut.where("text <> ''").select(*docs.columns))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: sources alternate by weight, and one that has run out leaves its share to the others.

    Rows with one id, source and size stand together, at the first of their slots.
    """
    i, source, chars, slot = (unused(docs, x) for x in ("of_id", "of_source", "of_chars", "slot"))
    slots = mix(docs, whole=True).groupBy(F.col("doc_id").alias(i), F.col("source").alias(source), F.col("chars").alias(chars)).agg(F.min("slot").alias(slot))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.coalesce("source", F.lit("")) == F.col(source)) & (F.coalesce(F.length("text"), F.lit(0)) == F.col(chars))
    return docs.join(written(slots, "slots"), same).orderBy(slot, "doc_id").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences; repeated rows are packed each."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_weights", source_weights),
    ("packing", packing),
]

#: Suffix sorts and token ids have no SQL form; tests hold every stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
