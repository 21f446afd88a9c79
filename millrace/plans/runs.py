"""Runs that keep count of themselves, sources with progress, the content store, and summaries of discovery and scraping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import ORACLES, query
from millrace.plans.returns import inter_event_returns
from millrace.plans.scores import SCORES, _scored
from millrace.plans.validation import PAGES, _pages
from millrace.plans.verdicts import overall_quality
from millrace.sources import feeds
from millrace.sources.content import contents, store
from millrace.sources.scratch import fresh, kept
from millrace.tables import load

_FAILED = {"text": "text_conf < 0.3", "image": "image_conf < 0.3", "market": "r IS NULL"}


@query(f"""WITH {SCORES} SELECT count(*) AS processed, {', '.join(f'count(*) FILTER ({c}) AS {k}_failures' for k, c in _FAILED.items())}, count(*) FILTER (round(confidence, 9) >= 0.3) AS successful, round(100.0 * count(*) FILTER (round(confidence, 9) >= 0.3) / count(*), 6) AS success_rate,
  round(avg(text_conf), 6) AS text_confidence, round(avg(image_conf), 6) AS image_confidence, round(avg(confidence), 6) AS confidence, count(*) FILTER (round(abs(score), 9) >= 0.5) AS extreme, true AS timed FROM scores""")
def scoring_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scoring pass that writes its rows, and what it observed of itself on the way: failures of parts, success rate, confidences.

    No second pass: the counts come out of the writing job.  `timed` says that the run's length was taken, of which rows a second follow.
    """
    import time

    watch = Observation("scoring")
    sure = F.round("confidence", 9) >= 0.3
    failed = {"text": F.col("text_conf") < 0.3, "image": F.col("image_conf") < 0.3, "market": F.col("market_conf") < 0.5}
    began = time.monotonic()
    kept(_scored(spark, sf_dir).observe(
        watch, F.count(F.lit(1)).alias("processed"), *[F.count_if(c).alias(f"{k}_failures") for k, c in failed.items()], F.count_if(sure).alias("successful"),
        F.avg("text_conf").alias("text_confidence"), F.avg("image_conf").alias("image_confidence"), F.avg("confidence").alias("confidence"), F.count_if(F.abs(F.round("score", 9)) >= 0.5).alias("extreme")), "scores")
    took, m = time.monotonic() - began, watch.get
    row = spark.createDataFrame([tuple(m[k] for k in m) + (took,)], ", ".join(f"{k} {'double' if k.endswith('confidence') else 'long'}" for k in m) + ", seconds double")
    per = F.try_divide("processed", "seconds")
    return row.select("processed", *[f"{k}_failures" for k in failed], "successful", F.round(100.0 * F.try_divide("successful", "processed"), 6).alias("success_rate"), *[F.round(c, 6).alias(c) for c in ("text_confidence", "image_confidence", "confidence")], "extreme", (per > 0).alias("timed"))


def write_feeds(pages: DataFrame, path: str) -> None:
    """Pages (page_id, url, title, published) as RSS files of at most 200 items."""
    text = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    date = F.coalesce(F.concat(F.lit("<pubDate>"), F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>")), F.lit(""))
    item = F.concat(F.lit("<item><title>"), text(F.col("title")), F.lit("</title><link>"), text(F.col("url")), F.lit("</link>"), date, F.lit("</item>"))
    files = pages.withColumn("part", F.floor(F.col("page_id") / 200)).groupBy("part").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.sort_array(F.collect_list(item)), ""), F.lit("</channel></rss>")).alias("value"))
    files.write.mode("append").partitionBy("part").text(path)


@query(f"""WITH {PAGES} SELECT url AS link, min(title) AS title, count(*) AS items, count(DISTINCT page_id % 2) AS runs FROM (SELECT page_id, url, title FROM articles_ WHERE trim(url) <> '') GROUP BY 1""")
def feed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of feed files read by a stream in two runs, each of which takes the files that came since the one before."""
    from millrace.streaming.queries import drained  # which imports this package

    feeds.register(spark)
    pages, path, at = _pages(spark, sf_dir).select("page_id", "url", "title", "published"), fresh(spark, "feeds"), fresh(spark, "feeds-at")
    runs = []
    for run in (0, 1):
        write_feeds(pages.where(F.col("page_id") % 2 == run), f"{path}/drop={run}")
        stream = spark.readStream.format("feed_files").option("suffix", ".txt").load(path)
        runs.append(drained(stream, None, "append", at).withColumn("run", F.lit(run)))
    both = runs[0].unionByName(runs[1])
    return both.groupBy("link").agg(F.min("title").alias("title"), F.count("*").alias("items"), F.countDistinct("run").alias("runs"))


@query("SELECT sha256(html) AS sha256, CAST(strlen(any_value(html)) AS BIGINT) AS bytes, true AS intact, count(*) AS pages FROM pages WHERE html IS NOT NULL GROUP BY 1")
def stored_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' contents in a content-addressed store, read back: each file's digest and size, whether it is intact, and how many pages have it."""
    path = fresh(spark, "contents")
    named = kept(store(load(spark, sf_dir, "pages"), "html", path, ".html"), "named")
    n = named.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("pages"))
    return contents(spark, path).drop("path").join(n, "sha256")


@query(f"""WITH i AS ({ORACLES['inter_event_returns']}) SELECT asset, count(*) AS periods, round(avg(gap), 6) AS mean_days, round(avg(ret) + 3.7e-9, 5) AS mean_ret, max(ret) AS best, min(ret) AS worst FROM i GROUP BY 1""")
def inter_event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods between articles: how long they are, and their mean, best and worst return."""
    return inter_event_returns(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("periods"), F.round(F.avg("gap"), 6).alias("mean_days"), F.round(F.avg("ret") + 3.7e-9, 5).alias("mean_ret"), F.max("ret").alias("best"), F.min("ret").alias("worst"))


@query(f"""WITH q AS ({ORACLES['overall_quality']}), d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), i AS (SELECT conv_id AS doc_id, count(*) AS images FROM conversations GROUP BY 1)
SELECT count(*) FILTER (n > 0) AS successful, count(*) FILTER (n = 0) AS failed, round(100.0 * count(*) FILTER (n > 0) / nullif(count(*), 0), 6) AS success_rate, CAST(coalesce(sum(i.images), 0) AS BIGINT) AS images, CAST(sum(n) AS BIGINT) AS content, count(*) FILTER (is_valid) AS valid, round(avg(quality) + 3.7e-6, 4) AS mean_quality
FROM d JOIN q USING (doc_id) LEFT JOIN i USING (doc_id)""")
def scrape_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over all articles brought: successes, images, characters, valid articles and mean quality."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    i = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("images"))
    r, some = d.join(overall_quality(spark, sf_dir), "doc_id").drop("images").join(i, "doc_id", "left"), F.col("n") > 0
    return r.agg(F.count_if(some).alias("successful"), F.count_if(~some).alias("failed"), F.round(100.0 * F.try_divide(F.count_if(some), F.count("*")), 6).alias("success_rate"), F.coalesce(F.sum("images"), F.lit(0)).alias("images"), F.sum("n").alias("content"), F.count_if("is_valid").alias("valid"), F.round(F.avg("quality") + 3.7e-6, 4).alias("mean_quality"))


@query(f"""WITH {PAGES} SELECT page_id, title, published, row_number() OVER (ORDER BY coalesce(published, DATE '0001-01-01') DESC, page_id) AS place FROM articles_ QUALIFY place <= 100""")
def newest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest discovered articles; those without a date come last."""
    p = _pages(spark, sf_dir).select("page_id", "title", "published").orderBy(F.coalesce("published", F.lit("0001-01-01").cast("date")).desc(), "page_id").limit(100)
    from pyspark.sql import Window as W

    return p.withColumn("place", F.row_number().over(W.orderBy(F.coalesce("published", F.lit("0001-01-01").cast("date")).desc(), "page_id")))  # a hundred rows
