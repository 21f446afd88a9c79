"""Quality rules: repetition and length rules, then a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every word and pair of adjacent words falls into one of `buckets` hash buckets.  Two multinomials over the buckets, one
of trusted documents and one of the whole corpus, give each bucket a log ratio; a document's score is the mean log
ratio of its n-grams, and it is kept at or above a fixed threshold.  DataFrame functions only.

The corpus counts cover every row.  The trusted side is fitted on a bounded sample: the `trusted_rows` trusted ids with
the smallest hash, few enough to broadcast.  The bucket table has a fixed size and goes into the plan as a constant,
so scoring is a scan without shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 13
TRUSTED_ROWS = 10_000
THRESHOLD = -0.1
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def with_hashes(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds w: the words, h: their hashes, g: the buckets of words and of pairs of adjacent words."""
    df = df.withColumn("w", words(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))


def with_buckets(df: DataFrame, buckets: int) -> DataFrame:
    n = F.size("h")
    one = F.transform("h", lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.pmod(F.xxhash64(F.get("h", i - 1), F.get("h", i)), F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("g", F.concat(one, two))


def bucket_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """(bucket, log_ratio) for the buckets that occur, with add-one smoothing; `trusted` holds ids in doc_id."""
    sample = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows).withColumn("t", F.lit(1))
    grams = with_buckets(with_hashes(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")), buckets)
    # An outer explode: for a plain one the optimizer would add a filter below that works out all n-grams again.
    rows = grams.select(F.coalesce("t", F.lit(0)).alias("t"), F.explode_outer("g").alias("bucket")).where("bucket IS NOT NULL")
    counts = rows.groupBy("bucket").agg(F.sum("t").alias("target"), F.count("*").alias("raw"))
    totals = counts.agg(F.sum("target").alias("targets"), F.sum("raw").alias("raws"))
    ratio = F.log((F.col("target") + 1) / (F.col("targets") + buckets)) - F.log((F.col("raw") + 1) / (F.col("raws") + buckets))
    return counts.join(F.broadcast(totals)).select("bucket", ratio.alias("log_ratio"))


def _covered(df: DataFrame, size: int = 5) -> DataFrame:
    """Adds n_repeat_words: words inside windows of `size` words that the text holds twice or more."""
    n = F.size("h")
    at = lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(size)))
    df = df.withColumn("windows", F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), at)))
    df = df.withColumn("windows", F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.col("windows")))
    df = df.withColumn("ranked", F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda x, k: F.get("ranked", k)["h"] == x["h"]
    twice = F.filter("ranked", lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | ((k > 0) & F.coalesce(same(x, k - 1), F.lit(False))))
    df = df.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    first = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
    count = F.aggregate("starts", first, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(size), p - a["last"])).alias("n")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(count, F.lit(0)).cast("long"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


def score(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """row, a struct of all columns of docs, and the MEASURES of its text.  ratios: each bucket's log ratio.

    llr is null without words.  A null text counts as empty: no words, so base_failed.
    """
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    df = with_hashes(df, "_text").withColumn("lines", F.filter(F.split("_text", "\n"), lambda x: removed(x, SPACES) != ""))
    df = _covered(with_buckets(df, len(ratios)))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate("g", F.lit(0.0), lambda a, b: a + F.get(table, b))
    n = F.size("w").cast("long")
    df = df.select(
        "row",
        n.alias("n_words"),
        F.length(removed(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(removed(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.when(n > 0, total / F.size("g")).alias("llr"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def scored(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """score() with the corpus's own ratios.  labels (doc_id, quality): rows of quality 1 name the trusted documents."""
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratios = [0.0] * buckets
    for row in bucket_ratios(plain, trusted, buckets, trusted_rows).collect():  # at most `buckets` rows
        ratios[row["bucket"]] = row["log_ratio"]
    return score(docs, ratios, threshold)


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs (doc_id, text and others) with the MEASURES of its text; `kept` is the verdict.

    Without trusted documents all log ratios follow from smoothing alone.  Rows with null ids, repeated rows and ties are
    scored alike, each on its own text.  Extra columns stay unless they have a measure's name; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c.lower() not in MEASURES]
    return scored(docs, labels, buckets, trusted_rows, threshold).select(*(F.col(f"row.`{c}`") for c in others), *MEASURES)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs.

    They pass through a generator, so that the filter isn't pushed below it, where every measure would be worked out a
    second time.
    """
    verdicts = scored(docs, labels).select(F.inline_outer(F.array(F.struct("row", "kept"))))
    return verdicts.where("kept").select("row.*")
