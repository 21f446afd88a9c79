"""Validation of articles, dates in many spellings, and text prepared for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import validate as V
from millrace.operators.carry import numbered
from millrace.plans.registry import query
from millrace.sources.scratch import kept
from millrace.tables import load

AS_OF = "2024-06-01"
DOMAINS = ["site1.", "site2.", "news"]
PUBLISHED = "CASE WHEN page_id % 7 = 0 THEN NULL ELSE DATE '2022-01-01' + CAST(page_id * 11 % 1000 AS INTEGER) END"
TITLE = r"trim(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '<[^>]+>', ' ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g'))"
AUTHOR = "CASE page_id % 3 WHEN 0 THEN 'Ann Example' WHEN 1 THEN 'somebody' ELSE '' END"
PAGES = f"""articles_ AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 13 = 0 THEN 'no scheme' ELSE url END AS url, {TITLE} AS title, {AUTHOR} AS author, {PUBLISHED} AS published, html AS body FROM pages)"""
_WORDS = lambda c: rf"list_distinct(regexp_extract_all(translate({c}, '{T.UPPER}', '{T.LOWER}'), '[a-z0-9_]+'))"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, title, author, published, body): pages as articles, some with broken fields."""
    i = F.col("page_id")
    return load(spark, sf_dir, "pages").select(
        "page_id", F.when(i % 11 == 0, "").when(i % 13 == 0, "no scheme").otherwise(F.col("url")).alias("url"), T.stripped(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        F.when(i % 3 == 0, "Ann Example").when(i % 3 == 1, "somebody").otherwise("").alias("author"),
        F.when(i % 7 != 0, F.date_add(F.lit("2022-01-01").cast("date"), (i * 11 % 1000).cast("int"))).alias("published"), F.col("html").alias("body"))


def word_set(c: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(T.searchable(F.col(c)), F.lit("[a-z0-9_]+"), F.lit(0)))


@query(f"""WITH {PAGES}, s AS (SELECT *, len(list_intersect({_WORDS('title')}, {_WORDS('url')}))::DOUBLE / nullif(len({_WORDS('title')}), 0) AS share, regexp_extract(lower(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1) AS host FROM articles_)
SELECT page_id, CAST(greatest(0.0, least(100.0, 100.0 - CASE WHEN contains(lower(url), 'a') THEN 0 ELSE 15 END - CASE WHEN share < 0.3 THEN 10 ELSE 0 END - CASE WHEN author = '' THEN 10 WHEN NOT contains(lower(author), 'ann') THEN 5 ELSE 0 END
  - CASE WHEN published IS NULL THEN 15 WHEN published > DATE '{AS_OF}' THEN 20 WHEN date_diff('day', published, DATE '{AS_OF}') > 365 THEN 5 ELSE 0 END)) AS DOUBLE) AS url_score,
  coalesce(date_diff('day', published, DATE '{AS_OF}') <= 30, true) AS is_fresh,
  array_to_string(list_filter([CASE WHEN url = '' THEN 'no url' END, CASE WHEN title = '' THEN 'no title' END, CASE WHEN coalesce(body, '') = '' THEN 'no content' END, CASE WHEN url <> '' AND host = '' THEN 'bad url' END,
    CASE WHEN url <> '' AND NOT ({' OR '.join(f"contains(host, '{d}')" for d in DOMAINS)}) THEN 'foreign host' END], lambda x: x IS NOT NULL), ', ') AS errors,
  url <> '' AND title <> '' AND length(trim(body)) >= 100 AS can_be_scored FROM s""")
def article_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL and metadata score, freshness, what the record lacks, and whether it can be scored, as of a given day."""
    as_of = F.lit(AS_OF).cast("date")
    title = word_set("title")
    share = F.try_divide(F.size(F.array_intersect(title, word_set("url"))), F.size(title))
    url, author = F.col("url"), F.col("author")
    return _pages(spark, sf_dir).select(
        "page_id", V.url_score(url, "a", share, author, F.lower(author).contains("ann"), F.col("published"), as_of).alias("url_score"), V.fresh(F.col("published"), as_of).alias("is_fresh"),
        F.array_join(V.structure_errors(url, F.col("title"), F.col("body"), DOMAINS), ", ").alias("errors"),
        ((url != "") & (F.col("title") != "") & (F.length(F.trim("body")) >= 100)).alias("can_be_scored"))


_RETURNS = {"r4": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE (value - 10) / 20 END", "r24": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE (value - 10) / 40 END"}
_MARKET = """100 - CASE WHEN price IS NULL OR price = 0 THEN 40 ELSE CASE WHEN price <= 0 THEN 30 ELSE 0 END + CASE WHEN price BETWEEN low AND high THEN 0 ELSE 25 END + CASE WHEN off > 3600 THEN 15 ELSE 0 END END
  - CASE WHEN abs(r4) > 0.5 THEN 10 ELSE 0 END - CASE WHEN abs(r24) > 0.5 THEN 10 ELSE 0 END - CASE WHEN r4 IS NULL AND r24 IS NULL THEN 20 ELSE 0 END"""


@query(f"""WITH rows_ AS (SELECT user_id % 500 AS article_id, event_id % 2 AS a, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value * 3000 END AS price, event_id % 7200 AS off, {', '.join(f'{v} AS {k}' for k, v in _RETURNS.items())},
  CASE event_id % 2 WHEN 0 THEN 10000 ELSE 500 END AS low, CASE event_id % 2 WHEN 0 THEN 200000 ELSE 10000 END AS high, event_id FROM events),
last AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY article_id, a ORDER BY event_id DESC) = 1)
SELECT article_id, count(*) AS assets, count(*) FILTER ({_MARKET} >= 50) AS valid, count(*) FILTER ({_MARKET} >= 50) / 2.0 * 100 AS quality FROM last GROUP BY 1""")
def market_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the two expected assets whose latest market data is valid: price in range and near in time, returns there and not extreme."""
    i, v = F.col("event_id"), F.col("value")
    rows = load(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("article_id"), (i % 2).alias("a"), "event_id", F.when(i % 9 != 0, v * 3000).alias("price"), (i % 7200).alias("off"), F.when(i % 4 != 0, (v - 10) / 20).alias("r4"), F.when(i % 3 != 0, (v - 10) / 40).alias("r24"))
    last = rows.groupBy("article_id", "a").agg(F.max_by(F.struct("price", "off", "r4", "r24"), "event_id").alias("x")).select("article_id", "a", "x.*")
    (low, high), (low2, high2) = V.PRICE_RANGES.values()
    score = V.asset_score(F.col("price"), F.when(F.col("a") == 0, low).otherwise(low2), F.when(F.col("a") == 0, high).otherwise(high2), F.col("off"), [F.col("r4"), F.col("r24")])
    g = last.groupBy("article_id").agg(F.count("*").alias("assets"), F.count_if(score >= 50).alias("valid"))
    return g.withColumn("quality", F.col("valid") / 2.0 * 100)


@query(r"""SELECT doc_id, md5(s) AS cleaned_md5, length(s) AS n_clean FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), 'https?://[!-;=?-~]+', '', 'g'), '[^ \t\r\n\f\v]+@[^ \t\r\n\f\v]+', '', 'g'), '[ \t\r\n\f\v]+', ' ', 'g'), '[^\x01-\x7f€£¥]+', '', 'g')) AS s FROM documents)""")
def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without tags, links, addresses and foreign letters, by their digest."""
    s = load(spark, sf_dir, "documents").select("doc_id", V.cleaned(F.col("text")).alias("s"))
    return s.select("doc_id", F.md5("s").alias("cleaned_md5"), F.length("s").cast("long").alias("n_clean"))


_LOW = f"translate(coalesce(text, ''), '{T.UPPER}', '{T.LOWER}')"
_COUNT = lambda terms: " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in terms)
_LIST = lambda terms: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for w in terms) + "], lambda x: x IS NOT NULL), ' ')"


@query(f"""WITH d AS (SELECT doc_id, {_LOW} AS t, text FROM documents), c AS (SELECT doc_id, text, t, {_COUNT(V.OPTION_TERMS)} AS o, {_COUNT(V.UP_TERMS)} AS u, {_COUNT(V.DOWN_TERMS)} AS n FROM d)
SELECT doc_id, round(least(1.0, o / 5.0), 6) AS relevance, {_LIST(V.OPTION_TERMS)} AS terms, {_LIST(V.STRATEGY_TERMS)} AS strategies, u AS bullish, n AS bearish, round((u - n)::DOUBLE / greatest(u + n, 1), 6) AS ratio FROM c""")
def term_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which option terms and strategies a text names, its relevance, and how bullish and bearish terms balance."""
    t = F.col("t")
    # Each text is lower-cased once, and each list looked for once.
    lists = {"o": V.OPTION_TERMS, "s": V.STRATEGY_TERMS, "u": V.UP_TERMS, "n": V.DOWN_TERMS}
    c = load(spark, sf_dir, "documents").select("doc_id", T.searchable(F.col("text")).alias("t")).select("doc_id", *[V.terms_in(t, v).alias(k) for k, v in lists.items()])
    c = c.select("doc_id", F.size("o").alias("o"), F.array_join("o", " ").alias("terms"), F.array_join("s", " ").alias("strategies"), F.size("u").alias("u"), F.size("n").alias("n"))
    up, down = F.col("u"), F.col("n")
    return c.select(
        "doc_id", F.round(F.least(F.lit(1.0), F.col("o") / 5.0), 6).alias("relevance"), "terms", "strategies",
        up.alias("bullish"), down.alias("bearish"), F.round((up - down) / F.greatest(up + down, F.lit(1)), 6).alias("ratio"))


# Phrases that a model's input spells out, and how the assets are named.
_PHRASES = [("gamma squeeze", "rapid upward move"), ("put", "downside option")]
ONE, TWO, EVERY = r"\b(?:btc|bitcoin)\b", r"\b(?:eth|ethereum)\b", r"\b(?:btc|bitcoin|eth|ethereum|crypto|cryptocurrency)\b"
# End of fixed values.
_REPLACED = "trim(coalesce(text, ''))"
for _old, _new in [*_PHRASES, *V.ABBREVIATIONS]:
    _REPLACED = f"replace({_REPLACED}, '{_old}', '{_new}')"
_SENTENCES = "list_transform(list_filter(string_split(coalesce(text, ''), '.'), lambda s: contains(lower(s), 'the') OR contains(lower(s), 'data')), lambda s: trim(s))"


@query(f"""SELECT doc_id, md5(substr(regexp_replace({_REPLACED}, '([0-9]+)[kK] strike', '\\1000 dollar strike price', 'g'), 1, {V.MODEL_CHARS})) AS model_md5,
  md5(CASE WHEN len({_SENTENCES}) > 0 THEN array_to_string({_SENTENCES}, '. ') ELSE substr(coalesce(text, ''), 1, {V.SENTENCE_CHARS}) END) AS sentences_md5, substr(text, 1, 100) AS summary FROM documents""")
def model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as a model would get it, whole and the sentences about one subject, by their digests; and a summary of 100 characters."""
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(V.for_model(t, _PHRASES)).alias("model_md5"), F.md5(V.asset_sentences(t, ["the", "data"])).alias("sentences_md5"), F.substring(t, 1, 100).alias("summary"))


@query(rf"""WITH c AS (SELECT doc_id, {_LOW} AS t FROM documents), m AS (SELECT doc_id, len(regexp_extract_all(t, '{ONE}')) AS one, len(regexp_extract_all(t, '{TWO}')) AS two,
  len(regexp_extract_all(t, '{EVERY}')) AS every, len(regexp_extract_all(t, '[a-z0-9_]+')) AS words FROM c)
SELECT doc_id, one AS btc_mentions, two AS eth_mentions, round(coalesce(every::DOUBLE / nullif(words, 0), 0), 6) AS density, round(one::DOUBLE / greatest(two, 1), 6) AS asset_ratio FROM m""")
def asset_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each asset is named, and the share of asset words."""
    t = F.col("t")
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    c = load(spark, sf_dir, "documents").select("doc_id", T.searchable(F.col("text")).alias("t")).select("doc_id", n(ONE).alias("btc_mentions"), n(TWO).alias("eth_mentions"), n(EVERY).alias("every"), n("[a-z0-9_]+").alias("words"))
    return c.select("doc_id", "btc_mentions", "eth_mentions", F.round(F.coalesce(F.try_divide("every", "words"), F.lit(0.0)), 6).alias("density"), F.round(F.col("btc_mentions") / F.greatest("eth_mentions", F.lit(1)), 6).alias("asset_ratio"))




@query("""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 7 THEN NULL WHEN 8 THEN NULL ELSE o_orderdate END AS at, CAST(month(o_orderdate) AS INTEGER) AS month, CASE WHEN o_orderkey % 9 = 7 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') END AS iso FROM orders""")
def date_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in seven spellings and among several fields, read back; month names; and ISO text in UTC."""
    d, i = F.col("o_orderdate"), F.col("o_orderkey") % 9
    spelled = F.lit(None).cast("string")
    for k, f in enumerate(V.DATE_FORMATS):
        spelled = F.when(i == k, F.date_format(d, f)).otherwise(spelled)
    first = F.when(i % 2 == 0, spelled)
    second = F.when(i == 7, "never").otherwise(spelled)
    utc = F.when(i == 7, "soon").when(i < 4, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    name = F.date_format(d, "MMMM")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", V.parsed_date([first, second]).cast("timestamp_ntz").alias("at"), V.month_number(F.when(i < 5, name).otherwise(F.substring(name, 1, 3))).alias("month"), V.utc_iso(utc).alias("iso"))


@query(f"""WITH u AS (SELECT doc_id, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(text) AS n_chars, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS place FROM u WHERE i = 1 AND length(text) > 200""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows fit for training: one of each text, with a body of more than 200 characters, numbered within sixteen shards."""
    d = load(spark, sf_dir, "documents").where("text IS NOT NULL")
    first = d.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.max(F.length("text")).cast("long").alias("n_chars"))
    fit = kept(first.where("n_chars > 200").select("doc_id", "n_chars"), "fit")
    return numbered(fit, F.col("doc_id") % 16, "doc_id", "place")


@query("""SELECT page_id, array_to_string(list_transform(string_split(regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1), '-'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM pages""")
def slug_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from the last part of a URL's path."""
    slug = F.regexp_extract("url", "([^/?#]+)/?(?:[?#].*)?$", 1)
    return load(spark, sf_dir, "pages").select("page_id", F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))).alias("title"))


@query(r"""WITH l AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '<a href="([^"]+)"', 1), regexp_extract_all(html, '\[[^\]]*\]\(([^)\s]+)\)', 1))) AS link FROM pages),
clean AS (SELECT page_id, rtrim(regexp_replace(link, '[?#].*$', ''), '/') AS link FROM l WHERE link NOT LIKE '%#%')
SELECT link, min(page_id) AS first_page, count(*) AS n FROM clean WHERE link <> '' GROUP BY 1""")
def discovered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, as HTML or Markdown, one row for each target with the page that first has it."""
    links = F.concat(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), F.lit(1)), F.regexp_extract_all("html", F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)))
    l = load(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("link")).where("link NOT LIKE '%#%'")
    l = l.select("page_id", F.rtrim(F.regexp_replace("link", "[?#].*$", ""), F.lit("/")).alias("link")).where("link <> ''")
    return l.groupBy("link").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
