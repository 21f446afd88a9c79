"""Weekly notes: which articles they are, their sentiment, and the returns after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.asof import last_before
from millrace.plans.registry import ORACLES, query
from millrace.plans.texts import _count_sql
from millrace.plans.validation import PAGES, _pages
from millrace.tables import DAILY, daily, load

# What makes a weekly note, and the probabilities of an empty text.
PATHS = ["/option-flows/", "/option-flow-"]
CATEGORIES = ["option flow", "weekly note"]
EMPTY = {"positive": 0.33, "neutral": 0.34, "negative": 0.33}
DIRECTION = {"positive": "bullish", "neutral": "neutral", "negative": "bearish"}
# End of fixed values.
SIDES = {"positive": "bullish", "neutral": "neutral", "negative": "bearish"}
#: The tables' prices end long before their pages begin: an article is set back by so many days.
SET_BACK = 9862
ASSETS = {"urgent": "1-URGENT", "high": "2-HIGH"}
DAYS = [1, 3, 7]


def is_weekly(url: Column, category: Column) -> Column:
    """An article whose path or category is that of a weekly note; false without a URL."""
    path = T.lower(F.coalesce(F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit("")))
    cat = T.lower(F.coalesce(category, F.lit("")))
    hit = F.lit(False)
    for p in PATHS:
        hit = hit | path.contains(p)
    for c in CATEGORIES:
        hit = hit | cat.contains(c)
    return (F.coalesce(url, F.lit("")) != "") & hit


def sentiment(n: dict[str, Column], empty: Column) -> dict[str, Column]:
    """Probabilities of a plain text from the lexicons' counts n, one added to each; the scalar is positive less negative.

    The likeliest counts, of equal ones the first; an empty text is neutral without confidence.
    """
    total = n["positive"] + n["neutral"] + n["negative"]
    prob = {k: F.when(empty, EMPTY[k]).otherwise(v / total) for k, v in n.items()}
    most = F.greatest(*n.values())
    primary = F.when(empty, "neutral").when(n["positive"] == most, "positive").when(n["neutral"] == most, "neutral").otherwise("negative")
    return {**prob, "primary": primary, "confidence": F.when(empty, 0.0).otherwise(most / total), "scalar": F.when(empty, 0.0).otherwise((n["positive"] - n["negative"]) / total)}


def _sentiment_sql(table: str, keys: str, plain: str) -> str:
    """SQL of sentiment() over a table whose column `raw` is the text."""
    return f"""plain_ AS (SELECT {keys}, trim(regexp_replace({plain}, '[^a-z0-9_]+', ' ', 'g')) AS p FROM {table}), words_ AS (SELECT *, list_filter(string_split(p, ' '), lambda w: w <> '') AS w FROM plain_),
n AS (SELECT {keys}, p, {', '.join(f'{_count_sql(T.SENTIMENT[v], 1)} + 1.0 AS {k}' for k, v in SIDES.items())} FROM words_), m AS (SELECT *, positive + neutral + negative AS total, greatest(positive, neutral, negative) AS most FROM n),
felt AS (SELECT {keys}, {', '.join(f"round(CASE WHEN p = '' THEN {EMPTY[k]} ELSE {k} / total END, 6) AS p_{k}" for k in SIDES)}, CASE WHEN p = '' THEN 'neutral' WHEN positive = most THEN 'bullish' WHEN neutral = most THEN 'neutral' ELSE 'bearish' END AS sentiment,
  round(CASE WHEN p = '' THEN 0 ELSE most / total END, 6) AS confidence, round(CASE WHEN p = '' THEN 0 ELSE (positive - negative) / total END, 6) AS scalar FROM m)"""


def felt(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    p = F.col("_p")
    s = sentiment({k: F.col(f"_{k}") for k in SIDES}, F.col("_empty"))
    named = F.create_map(*[F.lit(x) for kv in DIRECTION.items() for x in kv])
    # The counts are columns of their own, so that each is worked out once.
    found = df.select(*keys, T.plain(text).alias("_p")).withColumn("_h", T.hits(p, *T.SENTIMENT.values()))
    return found.select(*keys, (p == "").alias("_empty"), *[(T.counted(p, T.SENTIMENT[v], 1, F.col("_h")) + 1.0).alias(f"_{k}") for k, v in SIDES.items()]).select(
        *keys, *[F.round(s[k], 6).alias(f"p_{k}") for k in SIDES], F.try_element_at(named, s["primary"]).alias("sentiment"), F.round(s["confidence"], 6).alias("confidence"), F.round(s["scalar"], 6).alias("scalar"))


_LOW = f"translate(coalesce(text, ''), '{T.UPPER}', '{T.LOWER}')"


@query(f"WITH {_sentiment_sql('documents', 'doc_id', _LOW)} SELECT * FROM felt")
def article_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a positive, neutral and negative text, the side it is on, and one number from -1 to 1."""
    return felt(load(spark, sf_dir, "documents"), ["doc_id"], F.col("text"))


_URL = "CASE page_id % 4 WHEN 0 THEN url || '/option-flows/note' WHEN 1 THEN url || '/Option-Flow-2' ELSE url END"
_CATEGORY = "CASE page_id % 5 WHEN 0 THEN 'Weekly Notes' WHEN 1 THEN 'news' END"
_ASOF = " ".join(f"ASOF LEFT JOIN daily {n}_{d} ON {n}_{d}.asset = s.{n}_asset AND s.day + {d} >= {n}_{d}.date" for n in ASSETS for d in (0, *DAYS))


@query(f"""WITH {DAILY}, {PAGES}, ends AS (SELECT max(date) AS last_day FROM daily), named AS (SELECT page_id, {_URL} AS url, {_CATEGORY} AS category, title, published, body FROM articles_ WHERE url <> '' AND published IS NOT NULL AND coalesce(body, '') <> ''),
weekly AS (SELECT * FROM named WHERE contains(translate(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '{T.UPPER}', '{T.LOWER}'), '/option-flows/') OR contains(translate(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '{T.UPPER}', '{T.LOWER}'), '/option-flow-')
  OR contains(translate(coalesce(category, ''), '{T.UPPER}', '{T.LOWER}'), 'option flow') OR contains(translate(coalesce(category, ''), '{T.UPPER}', '{T.LOWER}'), 'weekly note')),
raw_ AS (SELECT page_id, translate(title || chr(10) || body, '{T.UPPER}', '{T.LOWER}') AS t FROM weekly), {_sentiment_sql('raw_', 'page_id', 't')},
s AS (SELECT page_id, url, published, least(published - {SET_BACK}, last_day) AS day, {', '.join(f"'{a}' AS {n}_asset" for n, a in ASSETS.items())} FROM weekly, ends)
SELECT s.page_id, s.url, s.published, sentiment, confidence, scalar, {', '.join(f'round({n}_{d}.close / nullif({n}_0.close, 0) - 1, 6) AS {n}_ret_{24 * d}h' for n in ASSETS for d in DAYS)} FROM s JOIN felt USING (page_id) {_ASOF}""")
def weekly_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weekly note with its sentiment and, for two assets, the returns a day, three days and a week after it, from the last prices known then."""
    i = F.col("page_id")
    a = _pages(spark, sf_dir).where("url <> '' AND published IS NOT NULL AND coalesce(body, '') <> ''")
    a = a.withColumns({"url": F.when(i % 4 == 0, F.concat("url", F.lit("/option-flows/note"))).when(i % 4 == 1, F.concat("url", F.lit("/Option-Flow-2"))).otherwise(F.col("url")), "category": F.when(i % 5 == 0, "Weekly Notes").when(i % 5 == 1, "news")})
    a = a.where(is_weekly(F.col("url"), F.col("category")))
    d = daily(spark, sf_dir)
    end = F.broadcast(d.agg(F.max("date").alias("last_day")))
    points = a.crossJoin(end).select("page_id", F.least(F.date_sub("published", SET_BACK), F.col("last_day")).alias("day"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("asset")) for n, x in ASSETS.items()])).alias("x"))
    points = points.select("page_id", "x.name", "x.asset", "day", F.explode(F.array(*[F.lit(k) for k in (0, *DAYS)])).alias("k")).withColumn("at", F.expr("date_add(day, k)"))
    known = last_before(points, d.withColumn("o", F.lit(0)), "asset", "at", "date", "close", "o")
    wide = known.groupBy("page_id").agg(*[F.max(F.when((F.col("name") == n) & (F.col("k") == k), F.col("close"))).alias(f"{n}_{k}") for n in ASSETS for k in (0, *DAYS)])
    said = felt(a, ["page_id", "url", "published"], F.concat_ws("\n", "title", "body")).select("page_id", "url", "published", "sentiment", "confidence", "scalar")
    return said.join(wide, "page_id").select(*said.columns, *[F.round(F.try_divide(F.col(f"{n}_{k}"), F.col(f"{n}_0")) - 1, 6).alias(f"{n}_ret_{24 * k}h") for n in ASSETS for k in DAYS])


@query(f"WITH w AS ({ORACLES['weekly_analysis']}) SELECT sentiment, count(*) AS n, round(avg(confidence), 5) AS confidence, round(avg(urgent_ret_168h), 5) AS mean_week FROM w GROUP BY 1")
def weekly_by_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_analysis(spark, sf_dir).groupBy("sentiment").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 5).alias("confidence"), F.round(F.avg("urgent_ret_168h"), 5).alias("mean_week"))
