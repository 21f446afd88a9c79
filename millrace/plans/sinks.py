"""Files of other shapes, written and read back, and what reads or keeps a part of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scoring import label
from millrace.functions.text import without_noise
from millrace.operators.dedupe import keep_last
from millrace.plans.registry import query
from millrace.plans.scores import SCORES, _scored
from millrace.sources import readers, writers
from millrace.sources.content import store
from millrace.sources.scratch import fresh, kept
from millrace.tables import DAILY, daily, load

_ASSETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"WITH {DAILY} SELECT asset, date, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close, volume FROM daily")
def vendor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as a vendor exports them: a folder for each asset, dd-MM-yyyy, quoted headers, thousands with commas; read back."""
    path = fresh(spark, "vendor")
    money = lambda c: F.format_number(F.round(c, 2), 2)
    d = daily(spark, sf_dir).select("asset", F.date_format("date", "dd-MM-yyyy").alias("Date"), money("close").alias("Price"), money("open").alias("Open"), money("high").alias("High"), money("low").alias("Low"), F.format_number("volume", 0).alias("Vol."), F.lit("0.00%").alias("Change %"))
    d.write.partitionBy("asset").option("header", True).option("quoteAll", True).csv(path)
    out = None
    for asset in _ASSETS:
        one = readers.vendor_prices(spark, f"{path}/asset={asset}", asset)
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT sha256, CAST(bytes AS BIGINT) AS bytes FROM (SELECT DISTINCT sha256(html) AS sha256, strlen(html) AS bytes FROM pages WHERE html IS NOT NULL) ORDER BY sha256 LIMIT 50")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty files of one extension in a folder with others, by name: their size and digest."""
    path = fresh(spark, "listing")
    kept(store(load(spark, sf_dir, "pages"), "html", path, ".html"), "named")
    kept(store(load(spark, sf_dir, "pages"), "url", path, ".txt"), "named")
    files = readers.files(spark, path, "*.html").withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    return files.orderBy("name").limit(50).select("sha256", F.col("length").alias("bytes"))


@query("SELECT 'l_shipdate,l_orderkey,l_extendedprice,l_linenumber,l_quantity' AS header, count(*) AS rows, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def ordered_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as CSV with preferred columns first, those that exist, and the others by name: the files' header, and what they hold."""
    path = fresh(spark, "csv")
    writers.ordered_csv(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("string").alias("l_shipdate")), path, ["l_shipdate", "not_there", "l_orderkey"])
    back = spark.read.option("header", True).csv(path)
    return back.agg(F.lit(",".join(back.columns)).alias("header"), F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("orders"))


@query("SELECT o_orderkey, o_orderkey % 7 AS BTC_ret_24h, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 11 END AS ETH_ret_72h FROM orders")
def packed_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return columns packed into one JSON column, stored, and unpacked."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("BTC_ret_24h"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 11).alias("ETH_ret_72h"))
    p = kept(writers.packed(o, "_ret_", "returns", ["o_orderkey"]), "packed")
    return p.select("o_orderkey", F.from_json("returns", "BTC_ret_24h long, ETH_ret_72h long").alias("r")).select("o_orderkey", "r.*")


_PATH = "CASE page_id % 4 WHEN 0 THEN 'C:\\Users\\me\\data\\' WHEN 1 THEN '/home/me/data/' WHEN 2 THEN '/Users/me/x/' ELSE '/srv/' END || CAST(page_id AS VARCHAR) || '.html'"


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'data/' WHEN 1 THEN 'data/' WHEN 2 THEN 'x/' ELSE 'srv/' END || CAST(page_id AS VARCHAR) || '.html' AS path FROM pages")
def clean_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without drive letters, home folders and users' names."""
    i = F.col("page_id")
    head = F.when(i % 4 == 0, "C:\\Users\\me\\data\\").when(i % 4 == 1, "/home/me/data/").when(i % 4 == 2, "/Users/me/x/").otherwise("/srv/")
    return load(spark, sf_dir, "pages").select("page_id", writers.sanitized(F.concat(head, i.cast("string"), F.lit(".html"))).alias("path"))


@query(f"""WITH {SCORES} SELECT event_id, CASE WHEN round(score, 9) > 0.5 THEN 'strong_bullish' WHEN round(score, 9) > 0.3 THEN 'bullish' WHEN round(score, 9) >= -0.3 THEN 'neutral' WHEN round(score, 9) >= -0.5 THEN 'bearish' ELSE 'strong_bearish' END AS label FROM scores""")
def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("event_id", label(F.round("score", 9)).alias("label"))


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's three latest events: a bounded history."""
    return keep_last(load(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 3)


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 1")
def newest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the progress file that was written last; the one before it holds the other half."""
    path, e = fresh(spark, "progress"), load(spark, sf_dir, "events").select("event_id", "event_type")
    for k in (0, 1):
        e.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").json(path)
    return readers.newest(spark, path, "event_id long, event_type string")


@query(f"WITH {DAILY} SELECT asset, count(*) AS n, min(date) AS first FROM daily GROUP BY 1")
def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices from the first provider that has any: the first knows none of the assets, the second all."""
    d = daily(spark, sf_dir)
    return readers.first_with_rows(d.where("asset = 'unknown'"), d, d.limit(1)).groupBy("asset").agg(F.count("*").alias("n"), F.min("date").alias("first"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS noiseless_md5 FROM documents WHERE NOT regexp_matches(lower(coalesce(text, '')), '(^|\\n)[ ]*(disclaimer|author\\(s\\)|recent articles)[ ]*(\\n|$)')")
def noiseless_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without boiler-plate sections; those that have none come out as they went in."""
    d = load(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    has = F.lower("text").rlike(r"(^|\n)[ ]*(disclaimer|author\(s\)|recent articles)[ ]*(\n|$)")
    return d.where(~has).select("doc_id", F.md5(without_noise(F.col("text"))).alias("noiseless_md5"))


@query(f"WITH {DAILY} SELECT asset, 1 AS files, count(*) AS rows FROM daily GROUP BY 1")
def price_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which assets a folder of price files has, with their files and rows, from the files themselves."""
    path = fresh(spark, "catalog")
    writers.price_files(daily(spark, sf_dir).repartition("asset"), path)
    f = spark.read.parquet(path).select(F.regexp_extract("_metadata.file_path", "asset=([^/]*)/", 1).alias("folder"), F.col("_metadata.file_path").alias("file"), "asset")
    return f.groupBy("asset").agg(F.countDistinct("file").alias("files"), F.count("*").alias("rows"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS title, 'theme' || CAST(o_custkey % 6 AS VARCHAR) AS primary_theme FROM orders WHERE (o_orderkey // 1000) % 4 < 2")
def tolerant_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a folder in which every fourth file isn't JSON and every fourth lacks the articles: the others come whole."""
    path = fresh(spark, "tolerant")
    o = load(spark, sf_dir, "orders").withColumn("part", F.floor(F.col("o_orderkey") / 1000))
    one = F.struct(F.col("o_orderkey").cast("string").alias("title"), F.struct(F.concat(F.lit("theme"), (F.col("o_custkey") % 6).cast("string")).alias("primary_theme")).alias("classification"))
    files = o.groupBy("part").agg(F.to_json(F.struct(F.collect_list(one).alias("unified_articles"))).alias("whole"))
    kind = F.col("part") % 4
    files.select("part", F.when(kind == 2, F.concat(F.lit("{"), "whole")).when(kind == 3, '{"articles": []}').otherwise(F.col("whole")).alias("value")).write.partitionBy("part").text(path)
    return readers.articles_json(spark, path, lines=True).select("title", "primary_theme")
