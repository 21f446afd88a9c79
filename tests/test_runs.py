"""Feed files with progress, the content store on disk, and a run's own counts."""

import datetime as dt
import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from millrace.plans.runs import scoring_run, write_feeds
from millrace.plans.scores import _scored
from millrace.sources import feeds
from millrace.sources.content import contents, store
from millrace.sources.scratch import fresh
from millrace.streaming.queries import drained

SF = "/root/testdata/sf0.001"


def rss(*items):
    return "<?xml version='1.0'?><rss><channel><title>T</title>" + "".join(f"<item>{x}</item>" for x in items) + "</channel></rss>"


def test_a_second_run_reads_only_new_files(spark, tmp_path):
    feeds.register(spark)
    folder = tmp_path / "feeds"
    (folder / "a").mkdir(parents=True)
    one = "<title>One &amp; all</title><link> http://x/1 </link><pubDate>Tue, 05 Mar 2024 10:00:00 +0200</pubDate>"
    (folder / "a" / "1.xml").write_text(rss(one, "<title>no link</title>", "<link>http://x/2</link><pubDate>soon</pubDate>"))
    (folder / "broken.xml").write_text("<rss><item><link>http://x/lost</link></item>")
    (folder / "other.json").write_text("{}")
    rows = spark.read.format("feed_files").load(str(folder)).collect()
    assert sorted((r.link, r.title, r.published, os.path.basename(r.file)) for r in rows) == [("http://x/1", "One & all", dt.datetime(2024, 3, 5, 8), "1.xml"), ("http://x/2", None, None, "1.xml")]
    at = fresh(spark, "feeds-at")
    run = lambda: sorted(r.link for r in drained(spark.readStream.format("feed_files").load(f"file://{folder}"), None, "append", at).collect())
    assert run() == ["http://x/1", "http://x/2"]
    time.sleep(0.02)
    (folder / "2.xml").write_text(rss("<link>http://x/3</link>", "<link>http://x/1</link>"))
    assert run() == ["http://x/1", "http://x/3"]
    (folder / "3.xml").write_text(rss())
    os.utime(folder / "3.xml", ns=(os.stat(folder / "2.xml").st_mtime_ns,) * 2)  # at the very time of the last one
    (folder / "4.xml").write_text(rss("<link>http://x/4</link>"))
    assert run() == ["http://x/4"]
    assert spark.read.format("feed_files").load(str(tmp_path / "nowhere")).collect() == []


def test_pages_as_feeds(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/?a=1&b=2", "a < b", dt.date(2024, 1, 2)), (2, "http://y", None, None), (300, "http://z", "]]>", dt.date(1999, 12, 31))], "page_id long, url string, title string, published date")
    write_feeds(pages, f"file://{tmp_path}/f")
    feeds.register(spark)
    got = sorted((r.link, r.title, r.published and r.published.date()) for r in spark.read.format("feed_files").option("suffix", ".txt").load(f"file://{tmp_path}/f").collect())
    assert got == [("http://x/?a=1&b=2", "a < b", dt.date(2024, 1, 2)), ("http://y", "", None), ("http://z", "]]>", dt.date(1999, 12, 31))]


def test_each_content_is_stored_once(spark, tmp_path):
    raw = [b"a", b"b" * 70_000, b"a", b"", None, "é".encode(), b"a"] * 4
    df = spark.createDataFrame([(x,) for x in raw], "x binary").repartition(4)
    path = f"file://{tmp_path}/store"
    rows = store(df, "x", path, ".x").collect()
    assert sorted((r.sha256 or "", r.bytes or 0) for r in rows) == sorted((hashlib.sha256(x).hexdigest() if x is not None else "", len(x or b"")) for x in raw)
    found = {f: open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(tmp_path / "store") for f in fs if not f.startswith(".")}
    assert {f: hashlib.sha256(x).hexdigest() + ".x" for f, x in found.items()} == {f: f for f in found}
    assert len(found) == len({x for x in raw if x is not None})
    assert not any(r.written for r in store(df, "x", path, ".x").collect())  # a re-run writes none
    text = spark.createDataFrame([("é",), ("new",)], "x string")
    assert {r.bytes: r.written for r in store(text, "x", path, ".x").collect()} == {2: False, 3: True}
    digest = hashlib.sha256(b"new").hexdigest()
    (tmp_path / "store" / digest[:2] / f"{digest}.x").write_bytes(b"changed")
    assert [r.sha256 for r in contents(spark, path).where("NOT intact").collect()] == [digest]


def test_a_run_counts_what_a_second_pass_counts(spark):
    got = scoring_run(spark, SF).first()
    s = _scored(spark, SF)
    want = s.agg(F.count("*").alias("n"), F.count_if(F.col("text_conf") < 0.3).alias("t"), F.count_if(F.round("confidence", 9) >= 0.3).alias("ok"), F.avg("confidence").alias("c")).first()
    assert (got.processed, got.text_failures, got.successful, got.timed) == (want.n, want.t, want.ok, True)
    assert got.confidence == pytest.approx(want.c, abs=1e-6) and got.success_rate == pytest.approx(100 * want.ok / want.n, abs=1e-6)
