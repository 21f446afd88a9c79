"""Readability, structured extraction, dates in texts, term weights, market context per day, rolling correlation and outliers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.rolling import days, full, indicators, last
from millrace.plans.registry import query
from millrace.plans.texts import LOWERED, WORDS, _in, _words
from millrace.sources.scratch import kept
from millrace.tables import DAILY, daily, load

SENTENCES = "greatest(1, len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: trim(translate(s, chr(10) || chr(13) || chr(9), '   ')) <> '')))"


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, len(w)::DOUBLE AS n, {SENTENCES}::DOUBLE AS s, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')))))::DOUBLE AS syl,
  len(list_filter(w, lambda x: len(regexp_extract_all(x, '[aeiouy]+')) >= 3))::DOUBLE AS hard, list_sum(list_transform(w, lambda x: length(x)))::DOUBLE AS letters FROM words_ WHERE len(w) > 0)
SELECT doc_id, round(206.835 - 1.015 * n / s - 84.6 * syl / n + 3.7e-7, 4) AS flesch, round(0.39 * n / s + 11.8 * syl / n - 15.59 + 3.7e-7, 4) AS grade, round(0.4 * (n / s + 100 * hard / n) + 3.7e-7, 4) AS fog, round(4.71 * letters / n + 0.5 * n / s - 21.43 + 3.7e-7, 4) AS ari FROM c""")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flesch ease, Flesch-Kincaid grade, fog and ARI.  A word's syllables are its runs of vowels, one at least."""
    # Words are counted in the whole plain text, where each stands behind a space; no word is looked at on its own.
    p, spaced = F.col("p"), F.concat(F.lit(" "), F.col("p"))
    count = lambda pattern: F.regexp_count(spaced, F.lit(pattern))
    d = load(spark, sf_dir, "documents").select("doc_id", "text", T.plain(F.col("text")).alias("p")).where("p <> ''")
    d = d.select("doc_id", "p", T.word_count(p).alias("words"), F.greatest(F.lit(1), T.sentence_count(F.coalesce("text", F.lit("")))).cast("double").alias("s"), count("[aeiouy]++").alias("runs"), count(" [^aeiouy ]++(?![^ ])").alias("without"), count(" [^aeiouy ]*+(?:[aeiouy]++[^aeiouy ]++){2}[aeiouy]").cast("double").alias("hard"))
    c = d.select("doc_id", F.col("words").cast("double").alias("n"), "s", (F.col("runs") + F.col("without")).cast("double").alias("syl"), "hard", (F.length("p") - F.col("words") + 1).cast("double").alias("letters"))
    n, s, y, h, k = (F.col(x) for x in ("n", "s", "syl", "hard", "letters"))
    return c.select("doc_id", F.round(206.835 - 1.015 * n / s - 84.6 * y / n + 3.7e-7, 4).alias("flesch"), F.round(0.39 * n / s + 11.8 * y / n - 15.59 + 3.7e-7, 4).alias("grade"), F.round(0.4 * (n / s + 100 * h / n) + 3.7e-7, 4).alias("fog"), F.round(4.71 * k / n + 0.5 * n / s - 21.43 + 3.7e-7, 4).alias("ari"))


# Patterns of option numbers and dates, and phrases that tell a flow's direction.
GREEKS = r"(?:delta|gamma|theta|vega)[ \t]*(?:of|:)?[ \t]*([0-9]+(?:\.[0-9]+)?)"
EXPIRY = r"(?:exp|expir|expires?)[ \t]*(?:on|in)?[ \t]*([a-z]{3,9}[ \t]*[0-9]{1,2}(?:st|nd|rd|th)?)"
UP = ["call buying", "put selling", "gamma squeeze", "skew firming", "upside flow", "bullish flow", "call dominance", "positive gamma", "long gamma", "call spread buying", "protective put selling", "vol selling in puts", "skew compression"]
DOWN = ["put buying", "call selling", "negative gamma", "skew steepening", "downside protection", "bearish flow", "put dominance", "short gamma", "call spread selling", "protective call buying", "put spread buying", "vol buying in puts", "skew expansion"]
# End of fixed values.


def _any(terms: list[str]) -> str:
    return " + ".join(f"CAST(contains(p, '{t}') AS INTEGER)" for t in terms)


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, len(list_filter(list_transform(regexp_extract_all({LOWERED}, '{GREEKS}', 1), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x BETWEEN 0 AND 1)) AS greeks, len(regexp_extract_all({LOWERED}, '{EXPIRY}', 1)) AS expiries,
  {_any(UP)} AS up, {_any(DOWN)} AS down, len(list_filter(w, lambda x: x IN ('call', 'calls'))) AS calls, len(list_filter(w, lambda x: x IN ('put', 'puts'))) AS puts, len(regexp_extract_all({LOWERED}, '{T.STRIKE}', 1)) AS strikes, len(regexp_extract_all({LOWERED}, '{T.NOTIONAL}', 1)) AS amounts FROM words_)
SELECT doc_id, CAST(greeks AS BIGINT) AS greeks, CAST(expiries AS BIGINT) AS expiries, CAST(calls AS BIGINT) AS calls, CAST(puts AS BIGINT) AS puts, CASE WHEN up > 1.2 * down THEN 'bullish' WHEN down > 1.2 * up THEN 'bearish' ELSE 'neutral' END AS direction,
  round(((strikes > 0)::INT + (amounts > 0)::INT + (expiries > 0)::INT + (greeks > 0)::INT + (up + down > 0)::INT) / 5.0, 6) AS confidence FROM c""")
def structured_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greeks, expiries, option types, the flow's direction (one side's phrases over 1.2 times the other's), and the share of five kinds found."""
    t, p = F.col("t"), F.col("p")
    greeks = F.size(F.filter(T.numbers(t, GREEKS), lambda x: x.between(0, 1)))
    found = lambda pattern: F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))
    hits = lambda terms: sum((p.contains(x).cast("int") for x in terms), F.lit(0))
    has = lambda *w: F.size(F.filter("w", lambda x: x.isin(*w)))
    c = _words(spark, sf_dir).withColumn("t", T.searchable(F.col("text"))).select("doc_id", greeks.cast("long").alias("greeks"), found(EXPIRY).cast("long").alias("expiries"), has("call", "calls").cast("long").alias("calls"), has("put", "puts").cast("long").alias("puts"), hits(UP).alias("up"), hits(DOWN).alias("down"), found(T.STRIKE).alias("strikes"), found(T.NOTIONAL).alias("amounts"))
    kinds = sum(((F.col(x) > 0).cast("int") for x in ("strikes", "amounts", "expiries", "greeks")), (F.col("up") + F.col("down") > 0).cast("int"))
    direction = F.when(F.col("up") > 1.2 * F.col("down"), "bullish").when(F.col("down") > 1.2 * F.col("up"), "bearish").otherwise("neutral")
    return c.select("doc_id", "greeks", "expiries", "calls", "puts", direction.alias("direction"), F.round(kinds / 5.0, 6).alias("confidence"))


@query(r"""WITH m AS (SELECT event_id, 'seen ' || strftime(ts, '%Y-%m-%d') || ' and ' || strftime(ts + INTERVAL 40 DAY, '%d/%m/%Y') || ' not 1999-13-45' AS text FROM events),
f AS (SELECT event_id, unnest(list_concat(list_transform(regexp_extract_all(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), lambda x: {'d': CAST(try_strptime(x, '%Y-%m-%d') AS DATE), 'c': 0.9}), list_transform(regexp_extract_all(text, '([0-9]{2}/[0-9]{2}/[0-9]{4})', 1), lambda x: {'d': CAST(try_strptime(x, '%d/%m/%Y') AS DATE), 'c': 0.6}))) AS x FROM m)
SELECT event_id, x.d AS date, CAST(x.c AS DOUBLE) AS confidence FROM f WHERE year(x.d) BETWEEN 2021 AND 2026""")
def date_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in texts with the confidence of their pattern; what is no date, or outside 2021 to 2026, is passed over."""
    e = load(spark, sf_dir, "events")
    t = F.concat(F.lit("seen "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" and "), F.date_format(F.col("ts") + F.expr("interval 40 days"), "dd/MM/yyyy"), F.lit(" not 1999-13-45"))
    kinds = [("([0-9]{4}-[0-9]{2}-[0-9]{2})", "yyyy-MM-dd", 0.9), ("([0-9]{2}/[0-9]{2}/[0-9]{4})", "dd/MM/yyyy", 0.6)]
    found = F.concat(*[_dates(t, p, f, c) for p, f, c in kinds])
    return e.select("event_id", F.explode(found).alias("x")).select("event_id", F.col("x.d").alias("date"), F.col("x.c").alias("confidence")).where(F.year("date").between(2021, 2026))


def _dates(t, pattern: str, form: str, sure: float):
    return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.to_date(F.try_to_timestamp(x, F.lit(form))).alias("d"), F.lit(sure).alias("c")))


def vocabulary(docs: DataFrame, one: str, size: int = 1000, least: int = 2, share: float = 0.95) -> list[tuple[str, int]]:
    """The `size` most frequent terms of at least `least` rows and at most `share` of them, with how many rows have each; equally frequent ones by name.

    Terms are the words of the array `one` and pairs of neighbours.  No pair is more frequent than either of its words, so once single words
    have filled the vocabulary, only pairs of words that are as frequent as its last one are counted: all that can be in it, and no others.
    """
    rows = docs.count()

    def most(terms: Column) -> DataFrame:
        """(term, n, df): occurrences and rows."""
        each = docs.select(terms.alias("t")).select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        have = docs.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= least) & (F.col("df") <= share * rows))
        return each.join(have, "term")

    first = lambda df: df.orderBy(F.desc("n"), "term").limit(size)
    words = [tuple(r) for r in first(most(F.col(one))).collect()]
    floor = words[-1][1] if len(words) == size else 1
    x = F.col(one)
    if floor > 1:
        often = docs.select(F.explode(one).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= floor)
        keep = [r.term for r in often.collect()]  # the vocabulary's words, and those in too many or too few rows
        x = F.transform(one, lambda w: F.when(w.isin(keep), w))
    both = [tuple(r) for r in first(most(F.filter(pairs(x), lambda w: w.isNotNull()))).collect()]
    return [(t, df) for t, _, df in sorted(words + both, key=lambda r: (-r[1], r[0]))[:size]]


def pairs(one: Column) -> Column:
    """Each two neighbours of an array with a space between; null where either is."""
    return F.when(F.size(one) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(one, 1, F.size(one) - 1), F.slice(one, 2, F.size(one) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


@query()
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's five heaviest one- and two-word terms, of the 1,000 most frequent in at least two and at most 95 % of documents."""
    from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
    from pyspark.ml.functions import vector_to_array

    stop = [w for w in StopWordsRemover.loadDefaultStopWords("english") if w.isalpha()]  # others hold signs that no word here has
    d = kept(_words(spark, sf_dir).select("doc_id", F.filter("w", lambda w: ~w.isin(stop)).alias("one")), "words")
    terms = vocabulary(d, "one")
    if not terms:
        return spark.createDataFrame([], f"doc_id {d.schema['doc_id'].dataType.simpleString()}, term string, weight double")
    names, rows = [t for t, _ in terms], d.count()
    idf = [math.log((rows + 1) / (df + 1)) for _, df in terms]
    x = CountVectorizerModel.from_vocabulary(names, "terms", "tf").transform(d.select("doc_id", F.concat("one", pairs(F.col("one"))).alias("terms")))
    weights = F.zip_with(vector_to_array("tf"), F.lit(idf), lambda a, b: a * b)
    top = F.slice(F.sort_array(F.filter(F.zip_with(weights, F.lit(names), lambda a, b: F.struct(a.alias("weight"), b.alias("term"))), lambda z: z["weight"] > 0), asc=False), 1, 5)
    return x.select("doc_id", F.explode(top).alias("z")).select("doc_id", F.col("z.term").alias("term"), F.round("z.weight", 6).alias("weight"))


@query(f"""WITH {DAILY}, r AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS return_1d, max(high) OVER (w ROWS 30 PRECEDING) AS high_31, min(low) OVER (w ROWS 30 PRECEDING) AS low_31, first_value(close) OVER (w ROWS 30 PRECEDING) AS first_31, lag(close, 7) OVER w AS close_7 FROM daily WINDOW w AS (PARTITION BY asset ORDER BY date)),
v AS (SELECT *, CASE WHEN count(return_1d) OVER (w ROWS 29 PRECEDING) = 30 THEN stddev_samp(return_1d) OVER (w ROWS 29 PRECEDING) * sqrt(365.0) END AS vol FROM r WINDOW w AS (PARTITION BY asset ORDER BY date))
SELECT asset, date, high_31, low_31, round((close / nullif(first_31, 0) - 1) * 100, 4) AS change_pct, CASE WHEN vol >= 100 THEN 'extreme' WHEN vol >= 75 THEN 'high' WHEN vol >= 40 THEN 'normal' WHEN vol >= 20 THEN 'low' WHEN vol IS NOT NULL THEN 'very_low' END AS vol_regime,
  CASE WHEN close / nullif(close_7, 0) - 1 > 0.05 AND close / nullif(first_31, 0) - 1 > 0.1 THEN 'bull' WHEN close / nullif(close_7, 0) - 1 < -0.05 AND close / nullif(first_31, 0) - 1 < -0.1 THEN 'bear' ELSE 'sideways' END AS market_regime, round(close * 0.9, 3) AS strike_otm_put, round(close * 1.1, 3) AS strike_otm_call FROM v""")
def options_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per asset and day: range and change over the last 31 rows, regimes of volatility and market, and strikes about the price."""
    w31 = last(31)
    close, first = F.col("close"), F.first("close").over(w31)
    x = indicators(daily(spark, sf_dir)).withColumns({"high_31": F.max("high").over(w31), "low_31": F.min("low").over(w31), "m": F.try_divide(close, first) - 1, "wk": F.try_divide(close, F.lag("close", 7).over(days())) - 1, "vol": F.col("volatility_30d") / 100})
    vol, m, wk = F.col("vol"), F.col("m"), F.col("wk")
    regime = F.when(vol >= 100, "extreme").when(vol >= 75, "high").when(vol >= 40, "normal").when(vol >= 20, "low").when(vol.isNotNull(), "very_low")
    market = F.when((wk > 0.05) & (m > 0.1), "bull").when((wk < -0.05) & (m < -0.1), "bear").otherwise("sideways")
    return x.select("asset", "date", "high_31", "low_31", F.round(m * 100, 4).alias("change_pct"), regime.alias("vol_regime"), market.alias("market_regime"), F.round(close * 0.9, 3).alias("strike_otm_put"), F.round(close * 1.1, 3).alias("strike_otm_call"))


@query(f"""WITH {DAILY}, z AS (SELECT asset, date, close, CASE WHEN count(close) OVER w30 = 30 THEN (close - avg(close) OVER w30) / nullif(stddev_samp(close) OVER w30, 0) END AS z,
  CASE WHEN count(close) OVER w30 = 30 AND stddev_pop(volume) OVER w30 > 0 THEN covar_pop(close, volume) OVER w30 / (stddev_pop(close) OVER w30 * stddev_pop(volume) OVER w30) END AS r FROM daily WINDOW w30 AS (PARTITION BY asset ORDER BY date ROWS 29 PRECEDING))
SELECT asset, date, round(z, 4) AS z, round(r, 4) AS rolling_corr, coalesce(abs(z) > 2.5, false) AS is_outlier FROM z""")
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations from the last 30 rows' mean, and the rolling correlation of price and volume."""
    c, w = F.col("close"), last(30)
    z = F.try_divide(c - full(30, c, F.avg), full(30, c, F.stddev_samp))
    r = F.when(F.count("close").over(w) == 30, F.try_divide(F.covar_pop("close", "volume").over(w), F.stddev_pop("close").over(w) * F.stddev_pop("volume").over(w)))
    x = daily(spark, sf_dir).withColumns({"z": z, "r": r})
    return x.select("asset", "date", F.round("z", 4).alias("z"), F.round("r", 4).alias("rolling_corr"), F.coalesce(F.abs("z") > 2.5, F.lit(False)).alias("is_outlier"))


@query(f"""WITH {WORDS}, b AS (SELECT d.doc_id, d.source, list_distinct(list_filter(w, lambda x: x IN {_in(T.COMMON)})) AS common, list_distinct(w) AS distinct_ FROM words_ d)
SELECT source, count(*) AS n, round(avg(len(common)::DOUBLE / nullif(len(distinct_), 0)), 6) AS mean_overlap, CAST(max(len(distinct_)) AS BIGINT) AS most_words FROM b GROUP BY 1""")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each document's distinct words that stand in a given set, by source."""
    common = F.array(*[F.lit(w) for w in T.COMMON])
    d = F.array_distinct("w")
    share = F.try_divide(F.size(F.array_intersect(d, common)), F.size(d))
    return _words(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(share), 6).alias("mean_overlap"), F.max(F.size(d)).cast("long").alias("most_words"))


@query("""SELECT conv_id, count(*) AS turns, max(turn) FILTER (role = 'user') AS last_user_turn, arg_max(role, (length(text), -turn)) AS longest_role, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY 1""")
def conversation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user_turn"), F.max_by("role", F.struct(n, -F.col("turn"))).alias("longest_role"), F.sum(n).cast("long").alias("chars"), F.round(F.avg(n), 6).alias("mean_chars"))
