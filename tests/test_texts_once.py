"""Text queries against plain Python on odd texts, and how often their plans go through a text."""

import re

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.more import readability
from millrace.plans.validation import term_context
from millrace.plans.weekly import article_sentiment

LETTERS = "İKÄẞΣ"
TEXTS = ["", " ", "...", None, "Aei ouy! bcd? banana_republic 42", "The Kall and cİall PUT.", "x" * 3000, "aba" * 2000, "Gamma squeeze, gamma squeeze; call buying rally", LETTERS + "A" + LETTERS]


def given(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_words_are_ascii_only(spark, tmp_path):
    df = spark.read.parquet(f"{given(spark, tmp_path)}/documents.parquet")
    low = lambda t: (t or "").translate(str.maketrans(T.UPPER, T.LOWER))
    for r in df.select("text", T.plain(F.col("text")).alias("p"), T.searchable(F.col("text")).alias("s"), T.word_list(T.plain(F.col("text"))).alias("w")).collect():
        want = re.sub("[^a-z0-9_]+", " ", low(r.text)).strip(" ")
        assert r.p == want and r.w == want.split()
        assert re.sub("[^ -~]", "", r.s) == re.sub("[^ -~]", "", low(r.text))


def test_readability_counts_words_without_looking_at_each(spark, tmp_path):
    at = given(spark, tmp_path)
    got = {r.doc_id: r for r in readability(spark, at).collect()}
    for i, t in enumerate(TEXTS):
        w = re.sub("[^a-z0-9_]+", " ", (t or "").translate(str.maketrans(T.UPPER, T.LOWER))).split()
        assert (i in got) == bool(w)
        if w:
            n, s = len(w), max(1, sum(bool(x.strip(" \n\r\t")) for x in re.split("[.!?]+", t)))
            runs = [len(re.findall("[aeiouy]+", x)) for x in w]
            syl, hard = sum(max(1, x) for x in runs), sum(x >= 3 for x in runs)
            assert abs(got[i].flesch - (206.835 - 1.015 * n / s - 84.6 * syl / n)) < 1e-3 and abs(got[i].fog - 0.4 * (n / s + 100 * hard / n)) < 1e-3
            assert abs(got[i].ari - (4.71 * sum(map(len, w)) / n + 0.5 * n / s - 21.43)) < 1e-3
    assert "lambdafunction" not in readability(spark, at)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_texts_are_scanned_once(spark, tmp_path):
    at = given(spark, tmp_path)
    plan = lambda q: q(spark, at)._jdf.queryExecution().optimizedPlan().toString()
    context, felt = plan(term_context), plan(article_sentiment)
    assert "translate(" not in context and context.count("lower(") == 1
    assert "translate(" not in felt and felt.count("regexp_extract_all(") == 1 and felt.count("gamma squeeze") == 1


def test_vocabulary_is_the_most_frequent_terms(spark):
    """Against plain counting, ties by name, with more words than fit (pairs are then looked for among frequent words only) and with fewer."""
    import random
    from collections import Counter

    from millrace.plans.more import vocabulary

    rng = random.Random(4)
    docs = [[f"w{min(int(rng.expovariate(0.25)), 30)}" for _ in range(rng.choice([0, 1, 2, 40]))] + ["all", "b"] for _ in range(60)] + [["once"] * 500]
    df = spark.createDataFrame([(d,) for d in docs], "one array<string>").repartition(4)
    bags = [Counter(d + [" ".join(x) for x in zip(d, d[1:])]) for d in docs]
    total, have = sum(bags, Counter()), Counter(t for b in bags for t in b)
    for size in (8, 25, 1000):
        usable = sorted((t for t in total if 2 <= have[t] <= 0.95 * len(docs)), key=lambda t: (-total[t], t))[:size]
        assert vocabulary(df, "one", size) == [(t, have[t]) for t in usable]
