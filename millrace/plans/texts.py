"""Text features, validation, cleaning and de-duplication of documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.dedupe import best_of, first_by_content, latest
from millrace.plans.registry import query
from millrace.tables import load

LOWERED = f"translate(coalesce(text, ''), '{T.UPPER}', '{T.LOWER}')"
WORDS = f"""plain_ AS (SELECT *, trim(regexp_replace({LOWERED}, '[^a-z0-9_]+', ' ', 'g')) AS p FROM documents),
words_ AS (SELECT *, list_filter(string_split(p, ' '), lambda w: w <> '') AS w FROM plain_)"""


def _in(terms: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


def _count_sql(terms: list[str], phrase: int) -> str:
    single, multi = [t for t in terms if " " not in t], [t for t in terms if " " in t]
    return " + ".join([f"len(list_filter(w, lambda x: x IN {_in(single)}))::DOUBLE", *[f"{phrase} * (length(p) - length(replace(p, '{t}', '')))::DOUBLE / {len(t)}" for t in multi]])


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").withColumn("p", T.plain(F.col("text"))).withColumn("w", T.word_list(F.col("p")))


@query(f"""WITH {WORDS} SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, CAST(len(w) AS BIGINT) AS n_words, round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / nullif(len(w), 0), 6) AS mean_word,
  CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: trim(translate(s, chr(10) || chr(13) || chr(9), '   ')) <> '')) AS BIGINT) AS n_sentences,
  CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS exclamations, CAST(length(text) - length(replace(text, '?', '')) AS BIGINT) AS questions,
  round((length(text) - length(translate(text, '{T.UPPER}', '')))::DOUBLE / nullif(length(text), 0), 6) AS capital_ratio FROM words_""")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, w = F.col("text"), F.col("w")
    return _words(spark, sf_dir).select(
        "doc_id", F.length(F.coalesce(t, F.lit(""))).cast("long").alias("n_chars"), F.size(w).cast("long").alias("n_words"),
        F.round(F.try_divide(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), F.size(w)), 6).alias("mean_word"), T.sentence_count(F.coalesce(t, F.lit(""))).cast("long").alias("n_sentences"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("exclamations"), F.regexp_count(t, F.lit(r"\?")).cast("long").alias("questions"),
        F.round(F.try_divide(F.length(t) - F.length(F.translate(t, T.UPPER, "")), F.length(t)), 6).alias("capital_ratio"))


LEXICONS = {"bullish": T.BULLISH, "bearish": T.BEARISH, "greek": T.GREEK, "vol": T.VOLATILITY}


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, greatest(len(w) / 100.0, 1) AS norm, {', '.join(f'{_count_sql(v, 2)} AS {k}' for k, v in LEXICONS.items())},
  {', '.join(f'CAST(len(list_filter(w, lambda x: x IN {_in(v)})) AS BIGINT) AS {k}_count' for k, v in T.VOCABULARY.items())} FROM words_)
SELECT doc_id, {', '.join(f'round({k} / norm, 6) AS {k}_score' for k in LEXICONS)}, round((bullish - bearish) / greatest(bullish + bearish, 1), 6) AS sentiment_ratio, {', '.join(f'{k}_count' for k in T.VOCABULARY)} FROM c""")
def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, h = F.col("p"), F.col("h")
    found = _words(spark, sf_dir).drop("w").withColumn("h", T.hits(p, *LEXICONS.values(), *T.VOCABULARY.values()))
    c = found.select("doc_id", F.greatest(T.word_count(p) / 100, F.lit(1.0)).alias("norm"), *[T.counted(p, v, 2, h).alias(k) for k, v in LEXICONS.items()], *[T.counted(p, v, found=h).cast("long").alias(f"{k}_count") for k, v in T.VOCABULARY.items()])
    up, down = F.col("bullish"), F.col("bearish")
    return c.select("doc_id", *[F.round(F.col(k) / F.col("norm"), 6).alias(f"{k}_score") for k in LEXICONS], F.round((up - down) / F.greatest(up + down, F.lit(1.0)), 6).alias("sentiment_ratio"), *[f"{k}_count" for k in T.VOCABULARY])


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, {', '.join(f'{_count_sql(v, 1)} AS {k}' for k, v in T.SENTIMENT.items())} FROM words_)
SELECT doc_id, CASE WHEN bullish > bearish AND bullish > neutral THEN 'bullish' WHEN bearish > bullish AND bearish > neutral THEN 'bearish' ELSE 'neutral' END AS sentiment,
  round(CASE WHEN bullish > bearish AND bullish > neutral THEN least(bullish / 10, 1.0) WHEN bearish > bullish AND bearish > neutral THEN least(bearish / 10, 1.0) ELSE least(neutral / 10, 0.5) END, 6) AS confidence FROM c""")
def keyword_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _words(spark, sf_dir).select("doc_id", "p", T.hits(F.col("p"), *T.SENTIMENT.values()).alias("h"))
    c = found.select("doc_id", *[T.counted(F.col("p"), v, found=F.col("h")).alias(k) for k, v in T.SENTIMENT.items()])
    up, down, flat = F.col("bullish"), F.col("bearish"), F.col("neutral")
    is_up, is_down = (up > down) & (up > flat), (down > up) & (down > flat)
    confidence = F.when(is_up, F.least(up / 10, F.lit(1.0))).when(is_down, F.least(down / 10, F.lit(1.0))).otherwise(F.least(flat / 10, F.lit(0.5)))
    return c.select("doc_id", F.when(is_up, "bullish").when(is_down, "bearish").otherwise("neutral").alias("sentiment"), F.round(confidence, 6).alias("confidence"))


_STRIKES = f"list_filter(list_transform(regexp_extract_all({LOWERED}, '{T.STRIKE}', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x > 10 AND x < 1000000)"
_PERCENTS = f"list_filter(list_transform(regexp_extract_all({LOWERED}, '{T.PERCENT}', 1), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x BETWEEN 0 AND 1000)"
_MONEY = f"list_filter(list_transform(regexp_extract_all({LOWERED}, '{T.NOTIONAL}', 1), lambda x, i: TRY_CAST(replace(x, ',', '') AS DOUBLE) * CASE left(regexp_extract_all({LOWERED}, '{T.NOTIONAL}', 2)[i], 1) WHEN 'b' THEN 1e9 WHEN 'm' THEN 1e6 ELSE 1e3 END), lambda x: x IS NOT NULL)"


@query(f"""WITH n AS (SELECT doc_id, {_STRIKES} AS s, {_PERCENTS} AS q, {_MONEY} AS m FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS strikes, round(coalesce(list_avg(s), 0), 6) AS mean_strike, coalesce(list_max(s), 0) AS max_strike, CAST(len(q) AS BIGINT) AS percentages, coalesce(list_max(q), 0) AS max_percentage,
  CAST(len(m) AS BIGINT) AS notionals, round(coalesce(list_sum(m), 0), 2) AS total_notional FROM n""")
def numeric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strikes in (10, 1e6), percentages in [0, 1000] and dollar amounts."""
    t = F.col("t")
    strikes = F.filter(T.numbers(t, T.STRIKE), lambda x: (x > 10) & (x < 1_000_000))
    percents = F.filter(T.numbers(t, T.PERCENT), lambda x: x.between(0, 1000))
    n = load(spark, sf_dir, "documents").select("doc_id", T.searchable(F.col("text")).alias("t")).select("doc_id", strikes.alias("s"), percents.alias("q"), T.notionals(t).alias("m"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    most = lambda c: F.coalesce(F.array_max(c), F.lit(0.0))
    return n.select("doc_id", F.size("s").cast("long").alias("strikes"), F.round(F.coalesce(F.try_divide(total("s"), F.size("s")), F.lit(0.0)), 6).alias("mean_strike"), most("s").alias("max_strike"), F.size("q").cast("long").alias("percentages"), most("q").alias("max_percentage"), F.size("m").cast("long").alias("notionals"), F.round(total("m"), 2).alias("total_notional"))


_SENT = "list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: trim(translate(s, chr(10) || chr(13) || chr(9), '   ')) <> '')"
_SPAM = " + ".join(f"CAST(contains(p, '{s}') AS INTEGER)" for s in T.SPAM)


@query(f"""WITH {WORDS}, s AS (SELECT *, substr(text, 1, 40) AS title, {_SENT} AS st, len(string_split(coalesce(text, ''), chr(10) || chr(10))) AS paragraphs,
  coalesce(len(list_filter(w, lambda x: x IN {_in(T.COMMON)}))::DOUBLE / nullif(len(w), 0) > 0.1, false) AS is_english,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE least(1.0, len(list_filter(w, lambda x: x IN {_in(T.OPTION_WORDS)})) / greatest(len(w) / 100.0, 1.0)) END AS relevance FROM words_),
m AS (SELECT *, list_sum(list_transform(st, lambda s: len(list_filter(string_split(translate(s, chr(10) || chr(13) || chr(9), '   '), ' '), lambda x: x <> ''))))::DOUBLE / nullif(len(st), 0) AS mean_len FROM s),
q AS (SELECT *, CASE WHEN len(st) = 0 AND trim(translate(coalesce(text, ''), chr(10) || chr(13) || chr(9), '   ')) = '' THEN 0.0 ELSE 100.0 - CASE WHEN paragraphs < 2 THEN 20 ELSE 0 END - CASE WHEN len(st) < 3 THEN 30 ELSE 0 END - CASE WHEN mean_len < 5 THEN 15 WHEN mean_len > 50 THEN 10 ELSE 0 END END AS structure FROM m),
v AS (SELECT *, greatest(0.0, least(100.0, 0.8 * (100.0 - CASE WHEN length(trim(text)) < 100 THEN 30 WHEN length(trim(text)) > 50000 THEN 10 ELSE 0 END - CASE WHEN length(trim(title)) < 10 THEN 15 WHEN length(trim(title)) > 200 THEN 5 ELSE 0 END
  - least(({_SPAM}) * 15, 45) - CASE WHEN contains(p, 'lorem ipsum') OR contains(p, 'test test') OR length(trim(text)) <= 50 THEN 25 ELSE 0 END - CASE WHEN is_english THEN 0 ELSE 20 END) + 0.2 * structure)) AS content FROM q)
SELECT doc_id, is_english, round(relevance, 6) AS relevance, CAST(round(structure, 6) AS DOUBLE) AS structure, CAST(round(content, 6) AS DOUBLE) AS content_quality, round((0.35 * content + 0.15 * relevance) / 0.5, 6) AS quality, (0.35 * content + 0.15 * relevance) / 0.5 >= 40 AND relevance >= 0.3 AS is_valid FROM v""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validator: language, relevance, structure and content scores, their weighted mean, and the verdict."""
    p, t = F.col("p"), F.col("text")
    h = F.col("h")
    s = _words(spark, sf_dir).drop("w").withColumn("h", T.hits(p, T.COMMON, T.OPTION_WORDS)).withColumns({"is_english": F.coalesce(T.english(p, h), F.lit(False)), "relevance": T.relevance(p, h), "structure": T.structure(t)})
    s = s.withColumn("content", T.content_quality(t, F.substring(t, 1, 40), p, F.col("is_english"), F.col("structure")))
    overall = (0.35 * F.col("content") + 0.15 * F.col("relevance")) / 0.5
    return s.select("doc_id", "is_english", F.round("relevance", 6).alias("relevance"), F.round("structure", 6).alias("structure"), F.round("content", 6).alias("content_quality"), F.round(overall, 6).alias("quality"), ((overall >= 40) & (F.col("relevance") >= 0.3)).alias("is_valid"))


@query(f"""WITH n AS (SELECT doc_id, md5(trim(regexp_replace({LOWERED}, '[ \\t\\r\\n]+', ' ', 'g'))) AS h FROM documents)
SELECT doc_id, h AS content_hash, first_value(doc_id) OVER (PARTITION BY h ORDER BY doc_id) AS first_id, row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 AS is_duplicate FROM n""")
def dedupe_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by the md5 of normalised text, with the first document that has it."""
    h = F.md5(F.trim(F.regexp_replace(T.lower(F.col("text")), r"[ \t\r\n]+", " ")))
    return first_by_content(load(spark, sf_dir, "documents").select("doc_id", h.alias("content_hash")), "content_hash", "doc_id")


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS len, turn % 3 AS images, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, turn, len, images, i FROM r WHERE i = 1 UNION ALL
  SELECT r.conv_id, CASE WHEN r.len > f.len OR r.images > f.images THEN r.turn ELSE f.turn END, CASE WHEN r.len > f.len OR r.images > f.images THEN r.len ELSE f.len END, CASE WHEN r.len > f.len OR r.images > f.images THEN r.images ELSE f.images END, r.i FROM f JOIN r ON r.conv_id = f.conv_id AND r.i = f.i + 1)
SELECT conv_id, turn, CAST(len AS BIGINT) AS len, images FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1""")
def dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per key by a fold: a later record replaces the kept one if it is longer or has more images."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("len"), (F.col("turn") % 3).alias("images"))
    return best_of(c, "conv_id", "turn", ["len", "images"])


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table keyed by user holds after all events were merged into it in order."""
    return latest(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_matches(url, '/en/|option.*flow') AS is_wanted,
  trim(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '<[^>]+>', ' ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')) AS title,
  CAST(len(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS BIGINT) AS n_links, CAST(len(list_distinct(regexp_extract_all(html, '<a href="([^"]+)"', 1))) AS BIGINT) AS n_distinct_links,
  CAST(length(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g'))) AS BIGINT) AS text_chars FROM pages""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, wanted URLs, title, links and the length of the text without tags."""
    h, u = F.col("html"), F.col("url")
    links = F.regexp_extract_all(h, F.lit('<a href="([^"]+)"'), F.lit(1))
    return load(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(u, "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract(u, "^https?://[^/?#]+([^?#]*)", 1).alias("path"), u.rlike("/en/|option.*flow").alias("is_wanted"),
        T.stripped(F.regexp_extract(h, "<title>([^<]*)</title>", 1)).alias("title"), F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_distinct_links"), F.length(T.stripped(h)).cast("long").alias("text_chars"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN printf('%.2f', l_quantity) || 'K' WHEN 1 THEN printf('%.1f', l_quantity) || 'M' WHEN 2 THEN printf('%.2f', l_tax) || '%' WHEN 3 THEN 'N/A' ELSE '"1,' || printf('%.0f', 100 + l_quantity) || '"' END AS raw,
  strftime(l_shipdate, '%d-%m-%Y') AS day FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 5 WHEN 3 THEN NULL ELSE TRY_CAST(regexp_replace(replace(replace(raw, ',', ''), '"', ''), '[KM%]$', '') AS DOUBLE) * CASE WHEN raw LIKE '%K' THEN 1e3 WHEN raw LIKE '%M' THEN 1e6 ELSE 1 END END, 4) AS value, CAST(strptime(day, '%d-%m-%Y') AS DATE) AS date FROM s""")
def trading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor spellings of numbers and dates, read back."""
    i = F.col("l_linenumber") % 5
    raw = F.when(i == 0, F.concat(F.format_string("%.2f", "l_quantity"), F.lit("K"))).when(i == 1, F.concat(F.format_string("%.1f", "l_quantity"), F.lit("M"))).when(i == 2, F.concat(F.format_string("%.2f", "l_tax"), F.lit("%"))).when(i == 3, "N/A").otherwise(F.concat(F.lit('"1,'), F.format_string("%.0f", F.col("l_quantity") + 100), F.lit('"')))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.trading_number(raw), 4).alias("value"), T.trading_date(F.date_format("l_shipdate", "dd-MM-yyyy")).alias("date"))


@query("""SELECT p.page_id, p.url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 3 = 0 AND rtrim(q.url, '/') = rtrim(p.url, '/')) AND p.url NOT LIKE '%#%' AND p.url NOT LIKE '%page=%'""")
def remaining_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered URLs that aren't processed yet, without fragments and pagination."""
    p = load(spark, sf_dir, "pages").select("page_id", "url").withColumn("u", F.rtrim("url", F.lit("/")))
    done = p.where("page_id % 3 = 0").select("u")
    return p.where("url NOT LIKE '%#%' AND url NOT LIKE '%page=%'").join(done, "u", "left_anti").select("page_id", "url")
