"""Image records and what article scores take from them: types, sentiment, quality, choice, de-duplication and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import images as I
from millrace.functions import text as T
from millrace.plans.registry import query
from millrace.tables import load

# Parts of the names of images that show no content.
NOT_CONTENT = "logo|icon|avatar|profile|banner|ad[_-]"
# End of fixed values.

K = "(conv_id * 7 + turn * 13)"
_SIGNS = lambda words: " + ".join(f"CAST(contains(ocr, '{w}') AS INTEGER)" for w in words)
_TIMES = lambda words: " + ".join(f"(length(ocr) - length(replace(ocr, '{w}', '')))::DOUBLE / {len(w)}" for w in words)
_POINTS = {k: " + ".join(f"CASE WHEN regexp_matches(ocr, '{p}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(url, '{p}') THEN 1 ELSE 0 END" for p in v) for k, v in I.TYPES.items()}
_MOST = f"greatest({', '.join(_POINTS)})"
RAW = f"""raw_images AS (SELECT conv_id AS article_id, turn AS seq, translate(coalesce(text, ''), '{T.UPPER}', '{T.LOWER}') AS ocr, text,
  'https://img.example/' || CAST(conv_id % 50 AS VARCHAR) || CASE turn % 4 WHEN 0 THEN '/flow-heatmap' WHEN 1 THEN '/chart' WHEN 2 THEN '/skew' ELSE '/img' END || CAST(turn AS VARCHAR) || '.png' AS url,
  ({K} % 11) / 10.0 AS confidence, {K} % 13 * 1000000 AS size, 60 + {K} % 200 AS width, 80 + {K} % 150 AS height, CASE WHEN {K} % 9 = 0 THEN 'failed' ELSE 'completed' END AS status FROM conversations)"""
IMAGES = f"""{RAW}, points AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _POINTS.items())} FROM raw_images),
images AS (SELECT article_id, seq, ocr, text, url, confidence, size, width, height, status, CASE WHEN {_MOST} = 0 THEN 'unknown' {' '.join(f"WHEN {k} = {_MOST} THEN '{k}'" for k in I.TYPES)} END AS kind,
  CASE WHEN {_TIMES(I.CHART_UP)} > {_TIMES(I.CHART_DOWN)} THEN 'bullish' WHEN {_TIMES(I.CHART_DOWN)} > {_TIMES(I.CHART_UP)} THEN 'bearish' ELSE 'neutral' END AS chart, {_SIGNS(I.SIGNS_UP)} AS up, {_SIGNS(I.SIGNS_DOWN)} AS down FROM points)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, seq, ocr, url, confidence, size, width, height, status, kind, chart, up, down): turns of talk as images of an article."""
    k = F.col("conv_id") * 7 + F.col("turn") * 13
    turn = F.col("turn")
    name = F.when(turn % 4 == 0, "/flow-heatmap").when(turn % 4 == 1, "/chart").when(turn % 4 == 2, "/skew").otherwise("/img")
    url = F.concat(F.lit("https://img.example/"), (F.col("conv_id") % 50).cast("string"), name, turn.cast("string"), F.lit(".png"))
    raw = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("article_id"), turn.alias("seq"), T.lower(F.col("text")).alias("ocr"), "text", url.alias("url"), (k % 11 / 10.0).alias("confidence"), (k % 13 * 1_000_000).alias("size"),
        (60 + k % 200).alias("width"), (80 + k % 150).alias("height"), F.when(k % 9 == 0, "failed").otherwise("completed").alias("status"))
    ocr = F.col("ocr")
    found = lambda words: sum((ocr.contains(w).cast("int") for w in words), F.lit(0))
    return raw.withColumns({"kind": I.image_type(ocr, F.col("url")), "chart": I.chart_sentiment(ocr), "up": found(I.SIGNS_UP), "down": found(I.SIGNS_DOWN)})


_FLOWS = ", ".join(f"CASE WHEN {' OR '.join(f"contains(ocr, '{w}')" for w in v)} THEN '{k}' END" for k, v in I.FLOWS.items())


@query(f"""WITH {IMAGES} SELECT article_id, seq, kind, chart, up, down,
  coalesce(array_to_string(list_sort(list_filter([CASE WHEN contains(kind, 'flow') THEN 'options_flow_detected' END, {_FLOWS}], lambda x: x IS NOT NULL)), ' '), '') AS signals FROM images""")
def image_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's type, chart sentiment, counts of bullish and bearish phrases, and flow signals."""
    i = images(spark, sf_dir)
    return i.select("article_id", "seq", "kind", "chart", "up", "down", F.array_join(I.flow_signals(F.col("ocr"), F.col("kind")), " ").alias("signals"))


_WEIGHT = f"CASE kind {' '.join(f"WHEN '{k}' THEN {w}" for k, w in I.TYPE_WEIGHTS.items())} ELSE {I.OTHER_WEIGHT} END"


@query(f"""WITH {IMAGES}, used AS (SELECT article_id, confidence, {_WEIGHT} * {I.SWING} * CASE WHEN chart = 'bullish' THEN 1 WHEN chart = 'bearish' THEN -1 ELSE 0 END AS s FROM images WHERE confidence > {I.LEAST_CONFIDENCE}),
g AS (SELECT article_id, count(*) AS n, avg(s) AS s, avg(confidence) AS c FROM used GROUP BY 1), a AS (SELECT article_id, count(*) AS images FROM images GROUP BY 1)
SELECT article_id, images, coalesce(n, 0) AS classified, round(least(1.0, greatest(-1.0, coalesce(s, 0))), 6) AS score, round(coalesce(c, 0), 6) AS confidence FROM a LEFT JOIN g USING (article_id)""")
def image_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image part of an article's score: the mean over images of enough confidence of their type's weight, by sentiment."""
    sign = F.when(F.col("chart") == "bullish", 1).when(F.col("chart") == "bearish", -1).otherwise(0)
    sure = F.col("confidence") > I.LEAST_CONFIDENCE
    g = images(spark, sf_dir).groupBy("article_id").agg(
        F.count("*").alias("images"), F.count_if(sure).alias("classified"),
        F.avg(F.when(sure, I.weight_of(F.col("kind")) * I.SWING * sign)).alias("s"), F.avg(F.when(sure, F.col("confidence"))).alias("c"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce("s", F.lit(0.0))))
    return g.select("article_id", "images", "classified", F.round(score, 6).alias("score"), F.round(F.coalesce("c", F.lit(0.0)), 6).alias("confidence"))


@query(f"""WITH {IMAGES}, first AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY seq) AS i FROM images QUALIFY i <= 3)
SELECT article_id, round(sum(CASE chart WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END * (confidence + 1e-8)) / sum(confidence + 1e-8), 6) AS score, round(avg(confidence), 6) AS confidence,
  count(*) FILTER (chart <> 'neutral') AS signals FROM first GROUP BY 1""")
def vision_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentiment of an article's first three images, weighted by confidence."""
    first = images(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("article_id").orderBy("seq"))).where("i <= 3")
    value = F.when(F.col("chart") == "bullish", 1.0).when(F.col("chart") == "bearish", -1.0).otherwise(0.0)
    w = F.col("confidence") + 1e-8
    return first.groupBy("article_id").agg(F.round(F.sum(value * w) / F.sum(w), 6).alias("score"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_if(F.col("chart") != "neutral").alias("signals"))


@query(f"""WITH {IMAGES}, two AS (SELECT article_id, seq, chart AS one, CASE WHEN seq % 3 = 0 THEN NULL WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END AS other,
  confidence AS c1, CASE WHEN seq % 3 = 0 THEN NULL ELSE confidence * 90 END AS c2 FROM images),
v AS (SELECT *, list_avg(list_filter([CASE one WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END, CASE WHEN other = 'bullish' THEN 1.0 WHEN other = 'bearish' THEN -1.0 WHEN other IS NOT NULL THEN 0.0 END], lambda x: x IS NOT NULL)) AS m,
  CASE WHEN c1 > 1 THEN c1 / 100 ELSE c1 END AS s1, CASE WHEN c2 > 1 THEN c2 / 100 ELSE c2 END AS s2 FROM two)
SELECT article_id, seq, CASE WHEN m > 0.3 THEN 'bullish' WHEN m < -0.3 THEN 'bearish' ELSE 'neutral' END AS sentiment, round(CASE WHEN s2 IS NULL THEN s1 ELSE (s1 + s2) / 2 END, 6) AS confidence FROM v""")
def vision_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of an image, by chart words and by phrases, as one; the second is missing for every third image."""
    i, missing = images(spark, sf_dir), F.col("seq") % 3 == 0
    other = F.when(missing, None).when(F.col("up") > F.col("down"), "bullish").when(F.col("down") > F.col("up"), "bearish").otherwise("neutral")
    one, two = I.as_share(F.col("confidence")), I.as_share(F.when(~missing, F.col("confidence") * 90))
    return i.select("article_id", "seq", I.fused(F.col("chart"), other).alias("sentiment"), F.round(F.when(two.isNull(), one).otherwise((one + two) / 2), 6).alias("confidence"))


_QUALITY = f"""100 - CASE WHEN size > {I.MOST_BYTES} THEN 20 WHEN size = 0 THEN 10 ELSE 0 END - CASE WHEN width < {I.LEAST_SIDE} OR height < {I.LEAST_SIDE} THEN 25 ELSE 0 END
  - CASE WHEN kind = 'unknown' THEN 15 ELSE 0 END - CASE WHEN confidence <= 0 THEN 10 WHEN confidence < 0.3 THEN 20 ELSE 0 END - CASE WHEN status <> 'completed' THEN 25 ELSE 0 END"""


@query(f"WITH {IMAGES} SELECT article_id, count(*) AS images, count(*) FILTER ({_QUALITY} >= 50) AS valid, round(100.0 * count(*) FILTER ({_QUALITY} >= 50) / count(*), 6) AS quality FROM images GROUP BY 1")
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of an article's images whose record is valid, in percent."""
    ok = I.quality(*(F.col(c) for c in ("url", "kind", "size", "width", "height", "confidence", "status"))) >= 50
    g = images(spark, sf_dir).groupBy("article_id").agg(F.count("*").alias("images"), F.count_if(ok).alias("valid"))
    return g.withColumn("quality", F.round(100.0 * F.col("valid") / F.col("images"), 6))


_PRIORITY = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(I.TYPES)) + " END"


@query(f"""WITH {IMAGES}, best AS (SELECT article_id, seq, kind, confidence FROM images WHERE kind <> 'unknown' AND status = 'completed' AND confidence > {I.LEAST_CONFIDENCE} QUALIFY row_number() OVER (PARTITION BY article_id, kind ORDER BY confidence DESC, seq) = 1)
SELECT article_id, seq, kind, confidence, row_number() OVER (PARTITION BY article_id ORDER BY {_PRIORITY}) AS place FROM best QUALIFY place <= 3""")
def alert_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three images for an alert: the surest of each type, in order of the types' priority."""
    kinds = list(I.TYPES)
    ok = images(spark, sf_dir).where((F.col("kind") != "unknown") & (F.col("status") == "completed") & (F.col("confidence") > I.LEAST_CONFIDENCE))
    best = ok.groupBy("article_id", "kind").agg(F.min_by(F.struct("seq", "confidence"), F.struct(-F.col("confidence"), F.col("seq"))).alias("x")).select("article_id", "kind", "x.seq", "x.confidence")
    priority = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return best.withColumn("place", F.row_number().over(W.partitionBy("article_id").orderBy(priority))).where("place <= 3").select("article_id", "seq", "kind", "confidence", "place")


@query(f"""WITH {IMAGES} SELECT article_id, count(*) AS images, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}_count" for k in [*I.TYPES, 'unknown'])},
  round(avg(confidence), 6) AS mean_confidence, min(confidence) AS min_confidence, CAST(sum(size) AS BIGINT) AS total_size, round(avg(size), 6) AS mean_size FROM images GROUP BY 1""")
def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article's images as numbers: how many of each type, their confidence and size."""
    kinds = [*I.TYPES, "unknown"]
    return images(spark, sf_dir).groupBy("article_id").agg(
        F.count("*").alias("images"), *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds],
        F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("confidence").alias("min_confidence"), F.sum("size").alias("total_size"), F.round(F.avg("size"), 6).alias("mean_size"))


@query(f"""WITH {RAW}, keyed AS (SELECT article_id, seq, CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 2 = 0 THEN md5(text) ELSE 'https://img.example/' || CAST(length(text) % 3 AS VARCHAR) END AS key FROM raw_images)
SELECT article_id, count(*) AS images, count(key) AS keyed, count(DISTINCT key) AS kept, array_to_string(list_sort(list(DISTINCT first_seq)), ' ') AS kept_seqs
FROM (SELECT *, CASE WHEN key IS NOT NULL THEN min(seq) OVER (PARTITION BY article_id, key) END AS first_seq FROM keyed) GROUP BY 1""")
def image_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of an article without repeats: the first with each hash or URL; those with neither go."""
    seq = F.col("seq")
    key = F.when(seq % 5 == 0, None).when(seq % 2 == 0, F.md5("text")).otherwise(F.concat(F.lit("https://img.example/"), (F.length("text") % 3).cast("string")))
    first = images(spark, sf_dir).groupBy("article_id", key.alias("key")).agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    kept = F.collect_list(F.when(F.col("key").isNotNull(), F.col("seq")))
    return first.groupBy("article_id").agg(F.sum("n").alias("images"), F.sum(F.when(F.col("key").isNotNull(), F.col("n")).otherwise(0)).alias("keyed"), F.count("key").alias("kept"), F.array_join(F.array_sort(kept), " ").alias("kept_seqs"))


@query(f"""WITH {RAW}, dated AS (SELECT article_id, seq, CASE seq % 4 WHEN 0 THEN '20' || lpad(CAST(20 + article_id % 6 AS VARCHAR), 2, '0') || '-0' || CAST(1 + seq % 9 AS VARCHAR) || '-15' WHEN 1 THEN 'on ' || CAST(1 + seq % 12 AS VARCHAR) || '/' || CAST(1 + article_id % 28 AS VARCHAR) || '/' || CAST(20 + article_id % 15 AS VARCHAR) WHEN 2 THEN '2/30/2024' ELSE ocr END AS s FROM raw_images),
found AS (SELECT *, coalesce(TRY_CAST(regexp_extract(s, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS DATE),
  TRY_CAST(CASE WHEN length(regexp_extract(s, '([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}|[0-9]{{2}})', 3)) = 2 THEN CASE WHEN TRY_CAST(regexp_extract(s, '([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}|[0-9]{{2}})', 3) AS INTEGER) <= 30 THEN '20' ELSE '19' END ELSE '' END
    || regexp_extract(s, '([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}|[0-9]{{2}})', 3) || '-' || lpad(regexp_extract(s, '([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}|[0-9]{{2}})', 1), 2, '0') || '-' || lpad(regexp_extract(s, '([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}|[0-9]{{2}})', 2), 2, '0') AS DATE)) AS date FROM dated)
SELECT date, count(*) AS images, arg_max(article_id, (article_id, seq)) AS article_id, arg_max(seq, (article_id, seq)) AS seq FROM found WHERE date IS NOT NULL GROUP BY 1""")
def images_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image results by the date found in them; of several with one date the last counts."""
    seq, art = F.col("seq"), F.col("article_id")
    s = F.when(seq % 4 == 0, F.concat(F.lit("20"), F.lpad((20 + art % 6).cast("string"), 2, "0"), F.lit("-0"), (1 + seq % 9).cast("string"), F.lit("-15")))
    s = s.when(seq % 4 == 1, F.concat(F.lit("on "), (1 + seq % 12).cast("string"), F.lit("/"), (1 + art % 28).cast("string"), F.lit("/"), (20 + art % 15).cast("string"))).when(seq % 4 == 2, "2/30/2024").otherwise(F.col("ocr"))
    found = images(spark, sf_dir).select("article_id", "seq", I.found_date(s).alias("date")).where("date IS NOT NULL")
    last = F.struct("article_id", "seq")
    return found.groupBy("date").agg(F.count("*").alias("images"), F.max(last).alias("x")).select("date", "images", "x.article_id", "x.seq")


@query("""WITH raw AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN replace(props, '}', ',}') ELSE replace(props, '}', ',' || chr(10) || '}') END AS r, props FROM events)
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, r <> props AS repaired FROM raw""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with code fences and trailing commas, read all the same: the first repair that makes JSON of them counts."""
    p, i = F.col("props"), F.col("event_id")
    raw = F.when(i % 4 == 0, p).when(i % 4 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i % 4 == 2, F.replace(p, F.lit("}"), F.lit(",}"))).otherwise(F.replace(p, F.lit("}"), F.lit(",\n}")))
    r = load(spark, sf_dir, "events").select("event_id", "props", raw.alias("r"))
    parsed = F.coalesce(*(F.try_parse_json(x) for x in I.json_attempts(F.col("r"))))
    return r.select("event_id", F.try_variant_get(parsed, "$.k", "long").alias("k"), (F.col("r") != F.col("props")).alias("repaired"))


@query(f"""WITH {IMAGES} SELECT kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent, count(*) FILTER (status = 'completed') AS completed,
  round(count(*) FILTER (status = 'completed') * 1.0 / count(*), 6) AS success_rate, count(*) FILTER (confidence >= 0.8) AS high_confidence, round(avg(confidence), 6) AS mean_confidence FROM images GROUP BY 1""")
def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified images by type: shares, success and confidence."""
    done = F.col("status") == "completed"
    g = images(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(done).alias("completed"), F.count_if(F.col("confidence") >= 0.8).alias("high_confidence"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("kind", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"), "completed", F.round(F.col("completed") / F.col("n"), 6).alias("success_rate"), "high_confidence", "mean_confidence")


@query(r"""WITH tags AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:img|a) [^>]*>')) AS tag FROM pages),
parts AS (SELECT page_id, tag, regexp_extract(tag, '(?:src|href)="([^"]*)"', 1) AS src, TRY_CAST(regexp_extract(tag, 'width="([0-9]+)"', 1) AS INTEGER) AS width, TRY_CAST(regexp_extract(tag, 'height="([0-9]+)"', 1) AS INTEGER) AS height FROM tags)
SELECT page_id, count(*) AS tags, count(*) FILTER (coalesce(width >= 100, true) AND coalesce(height >= 100, true) AND NOT regexp_matches(lower(src), '{NOT_CONTENT}')) AS content FROM parts GROUP BY 1""".replace("{NOT_CONTENT}", NOT_CONTENT))
def content_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media and link tags of a page that may show content: large enough where sizes are given, and no logo or the like."""
    tags = load(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(?:img|a) [^>]*>"), F.lit(0))).alias("tag"))
    side = lambda name: F.regexp_extract("tag", f'{name}="([0-9]+)"', 1).try_cast("int")
    src = F.lower(F.regexp_extract("tag", '(?:src|href)="([^"]*)"', 1))
    large = F.coalesce(side("width") >= 100, F.lit(True)) & F.coalesce(side("height") >= 100, F.lit(True))
    return tags.groupBy("page_id").agg(F.count("*").alias("tags"), F.count_if(large & ~src.rlike(NOT_CONTENT)).alias("content"))
