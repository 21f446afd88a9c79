"""Smaller operators: summaries written to files and read back, content-addressed names, best models, numbers in images, and
forecasts' intervals, decay and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.images import RAW, images
from millrace.plans.more import structured_extract
from millrace.plans.registry import ORACLES, query
from millrace.plans.reports import weight_search
from millrace.plans.returns import FACTS, facts
from millrace.plans.texts import keyword_sentiment
from millrace.sources.scratch import fresh, kept
from millrace.tables import ARTICLES, DAILY, articles, daily, load


@query(f"""WITH {FACTS}, f AS (SELECT bias, ret, last_day(date) AS month FROM facts WHERE days = 7), stats AS (SELECT bias, count(ret) AS n, round(avg(ret), 6) AS mean_ret, round(avg(CASE WHEN bias = 'bullish' THEN CAST(ret > 0 AS INTEGER) WHEN bias = 'bearish' THEN CAST(ret < 0 AS INTEGER) END), 6) AS hit_rate FROM f GROUP BY 1),
months AS (SELECT bias, month, round(avg(ret), 6) AS month_ret FROM f GROUP BY 1, 2) SELECT bias, n, mean_ret, hit_rate, month, month_ret FROM stats JOIN months USING (bias)""")
def summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and hit rates of each sentiment with their monthly trend, written as nested JSON and as flat CSV, read back from both."""
    r, b = F.col("ret"), F.col("bias")
    f = facts(spark, sf_dir).where("days = 7")
    hit = F.when(b == "bullish", (r > 0).cast("int")).when(b == "bearish", (r < 0).cast("int"))
    months = f.groupBy("bias", F.last_day("date").alias("month")).agg(F.round(F.avg(r), 6).alias("month_ret"))
    trend = months.groupBy("bias").agg(F.sort_array(F.collect_list(F.struct("month", "month_ret"))).alias("trend"))
    stats = f.groupBy("bias").agg(F.count(r).alias("n"), F.round(F.avg(r), 6).alias("mean_ret"), F.round(F.avg(hit), 6).alias("hit_rate"))
    nested = stats.join(trend, "bias")
    json, csv = fresh(spark, "summary-json"), fresh(spark, "summary-csv")
    nested.write.json(json)
    spark.read.schema(nested.schema).json(json).select("bias", "n", "mean_ret", "hit_rate", F.inline("trend")).write.option("header", True).csv(csv)
    return spark.read.option("header", True).schema("bias string, n long, mean_ret double, hit_rate double, month date, month_ret double").csv(csv)


@query("""WITH h AS (SELECT page_id, sha256(coalesce(html, '')) AS sha FROM pages), first AS (SELECT sha, min(page_id) AS first_id, count(*) AS copies FROM h GROUP BY 1)
SELECT page_id, 'old/' || CAST(page_id AS VARCHAR) || '.html' AS old_path, substr(sha, 1, 2) || '/' || sha || '.html' AS stored_path, page_id = first_id AS is_first, copies FROM h JOIN first USING (sha)""")
def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page's content lies in a store named by content, and which page put it there: the map from old paths to new."""
    h = load(spark, sf_dir, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"))
    first = h.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    old = F.concat(F.lit("old/"), F.col("page_id").cast("string"), F.lit(".html"))
    return h.join(first, "sha").select("page_id", old.alias("old_path"), F.concat(F.substring("sha", 1, 2), F.lit("/"), "sha", F.lit(".html")).alias("stored_path"), (F.col("page_id") == F.col("first_id")).alias("is_first"), "copies")


@query("""WITH map_ AS (SELECT page_id, substr(sha256(coalesce(html, '')), 1, 8) AS new FROM pages), refs AS (SELECT conv_id, turn, conv_id * 3 + turn AS page_id FROM conversations)
SELECT conv_id, array_to_string(list(coalesce(new, 'unknown-' || CAST(r.page_id AS VARCHAR)) ORDER BY turn), ' ') AS paths FROM refs r LEFT JOIN map_ m ON m.page_id = r.page_id GROUP BY 1""")
def remapped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's list of image paths with every path replaced by its new one, in order; unknown ones are marked."""
    new = load(spark, sf_dir, "pages").select("page_id", F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 8).alias("new"))
    refs = load(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 3 + F.col("turn")).alias("page_id")).join(new, "page_id", "left")
    path = F.coalesce("new", F.concat(F.lit("unknown-"), F.col("page_id").cast("string")))
    return refs.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", path.alias("p")))), lambda x: x["p"]), " ").alias("paths"))


@query(f"""WITH {DAILY}, {ARTICLES}, ends AS (SELECT asset, min(date) + 30 AS lo, max(date) - 30 AS hi FROM daily GROUP BY 1)
SELECT article_id, greatest(lo, least(hi, date)) AS date, date < lo OR date > hi AS moved FROM articles JOIN ends USING (asset)""")
def clamped_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article dates held within what is known of their asset."""
    ends = daily(spark, sf_dir).groupBy("asset").agg(F.date_add(F.min("date"), 30).alias("lo"), F.date_sub(F.max("date"), 30).alias("hi"))
    d = F.col("date")
    return articles(spark, sf_dir).join(ends, "asset").select("article_id", F.greatest("lo", F.least("hi", d)).alias("date"), ((d < F.col("lo")) | (d > F.col("hi"))).alias("moved"))


@query("""WITH m AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS marker FROM conversations GROUP BY 1)
SELECT conv_id, turn, role FROM conversations JOIN m USING (conv_id) WHERE turn > marker QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2""")
def after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation, skip until the first answer, then take two turns."""
    c = load(spark, sf_dir, "conversations")
    m = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("marker"))
    rest = c.join(m, "conv_id").where("turn > marker").withColumn("i", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    return rest.where("i <= 2").select("conv_id", "turn", "role")


_METRICS = ("information_ratio", "hit_rate", "correlation", "combined")


@query(f"""WITH m AS ({ORACLES['weight_search']}), long AS ({' UNION ALL '.join(f"SELECT '{k}' AS metric, signal_weight, bias_weight, confidence_weight, {k} AS value FROM m" for k in _METRICS)})
SELECT metric, max(value) AS best, arg_max(struct_pack(s := signal_weight, b := bias_weight, c := confidence_weight), (value, signal_weight, bias_weight)).s AS signal_weight FROM long GROUP BY 1""")
def best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate by each metric; of equals the one with the larger weights."""
    m = weight_search(spark, sf_dir).unpivot(["signal_weight", "bias_weight", "confidence_weight"], list(_METRICS), "metric", "value")
    return m.groupBy("metric").agg(F.max("value").alias("best"), F.max_by("signal_weight", F.struct("value", "signal_weight", "bias_weight")).alias("signal_weight"))


# Patterns of numbers in images' text.
OCR = {
    "strikes": [r"([0-9]+k)[ \t\r\n]*(?:strike|level|price)", r"([0-9]{4,6})[ \t\r\n]*(?:strike|level)", r"\$([0-9]+k?)[ \t\r\n]*(?:strike|call|put)"],
    "notionals": [r"\$([0-9]+(?:\.[0-9]+)?)[ \t\r\n]*(?:million|m)", r"\$([0-9]+(?:\.[0-9]+)?k)", r"([0-9]+(?:\.[0-9]+)?)[ \t\r\n]*million"],
    "percentages": [r"([0-9]+(?:\.[0-9]+)?)%"],
    "dates": [r"((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z0-9_]*[ \t\r\n]*[0-9]*)", "([0-9]{1,2}[/-][0-9]{1,2}(?:[/-][0-9]{2,4})?)"],
    "prices": [r"([0-9]{4,6})[ \t\r\n]*(?:usd|\$)", r"([0-9]+k)[ \t\r\n]*(?:level|price|btc|eth)"],
}
# End of fixed values.


@query(f"""WITH {RAW} SELECT article_id, seq, {', '.join(f"CAST({' + '.join(f'len(regexp_extract_all(ocr, $p${p}$p$, 1))' for p in v)} AS BIGINT) AS {k}" for k, v in OCR.items())},
  coalesce(regexp_extract(ocr, $p${OCR['percentages'][0]}$p$, 1), '') AS first_percentage FROM raw_images""")
def image_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strikes, amounts, percentages, dates and prices read in each image's text."""
    ocr = F.col("ocr")
    found = lambda ps: sum((F.size(F.regexp_extract_all(ocr, F.lit(p), F.lit(1))) for p in ps), F.lit(0)).cast("long")
    return images(spark, sf_dir).select("article_id", "seq", *[found(v).alias(k) for k, v in OCR.items()], F.regexp_extract(ocr, OCR["percentages"][0], 1).alias("first_percentage"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Strongly BULLISH' WHEN 1 THEN 'bear market' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE 'Flat' END AS raw FROM events)
SELECT coalesce(CASE WHEN contains(lower(raw), 'bull') THEN 'bullish' WHEN contains(lower(raw), 'bear') THEN 'bearish' END, 'neutral') AS sentiment, count(*) AS n, count(DISTINCT raw) AS spellings FROM s GROUP BY 1""")
def sentiment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiments in free spelling as three names."""
    i = F.col("event_id") % 5
    raw = F.when(i == 0, "Strongly BULLISH").when(i == 1, "bear market").when(i == 2, None).when(i == 3, "").otherwise("Flat")
    low = F.lower("raw")
    name = F.when(low.contains("bull"), "bullish").when(low.contains("bear"), "bearish").otherwise("neutral")
    return load(spark, sf_dir, "events").select(raw.alias("raw")).groupBy(name.alias("sentiment")).agg(F.count("*").alias("n"), F.countDistinct("raw").alias("spellings"))


@query("""SELECT doc_id, hex(unhex(md5(coalesce(text, '')))) AS digest, octet_length(unhex(md5(coalesce(text, '')))) AS bytes FROM documents""")
def digests_as_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal digests as bytes and back."""
    raw = F.try_to_binary(F.md5(F.coalesce("text", F.lit(""))), F.lit("hex"))
    return load(spark, sf_dir, "documents").select("doc_id", F.hex(raw).alias("digest"), F.octet_length(raw).cast("long").alias("bytes"))


@query(f"""WITH x AS ({ORACLES['structured_extract']}) SELECT count(*) AS n, count(*) FILTER (expiries > 0) AS with_expiries, count(*) FILTER (calls + puts > 0) AS with_types, count(*) FILTER (greeks > 0) AS with_greeks, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (direction = 'bullish') AS bullish, count(*) FILTER (direction = 'bearish') AS bearish, count(*) FILTER (direction NOT IN ('bullish', 'bearish')) AS other FROM x""")
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each kind of extract, and which way their flows point."""
    has = lambda c: F.count_if(F.col(c) > 0)
    d = F.col("direction")
    return structured_extract(spark, sf_dir).agg(F.count("*").alias("n"), has("expiries").alias("with_expiries"), F.count_if(F.col("calls") + F.col("puts") > 0).alias("with_types"), has("greeks").alias("with_greeks"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(d == "bullish").alias("bullish"), F.count_if(d == "bearish").alias("bearish"), F.count_if(~d.isin("bullish", "bearish")).alias("other"))


@query(f"""WITH k AS ({ORACLES['keyword_sentiment']}), s AS (SELECT doc_id, CASE sentiment WHEN 'bullish' THEN confidence WHEN 'bearish' THEN -confidence ELSE 0 END AS score FROM k), j AS (SELECT s.doc_id, score, toxic FROM s JOIN labels USING (doc_id) ORDER BY md5(CAST(s.doc_id AS VARCHAR)), s.doc_id LIMIT 100)
SELECT count(*) AS n, round(avg(CASE WHEN CASE WHEN score > 0.1 THEN 1 WHEN score < -0.1 THEN -1 ELSE 0 END = toxic THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) FILTER (score > 0.1) AS up, count(*) FILTER (score < -0.1) AS down FROM j""")
def sentiment_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword sentiment on a hundred labelled documents, chosen by hash: how often its bin is the label."""
    s = F.col("sentiment")
    score = F.when(s == "bullish", F.col("confidence")).when(s == "bearish", -F.col("confidence")).otherwise(0.0)
    j = keyword_sentiment(spark, sf_dir).select("doc_id", score.alias("score")).join(load(spark, sf_dir, "labels"), "doc_id")
    few = j.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(100)
    side = F.when(F.col("score") > 0.1, 1).when(F.col("score") < -0.1, -1).otherwise(0)
    return few.agg(F.count("*").alias("n"), F.round(F.avg((side == F.col("toxic")).cast("double")), 6).alias("accuracy"), F.count_if(F.col("score") > 0.1).alias("up"), F.count_if(F.col("score") < -0.1).alias("down"))


# ---- forecasts

_FIT = "count(*) AS n, regr_slope(ret, signal) AS b, regr_intercept(ret, signal) AS a, regr_sxx(ret, signal) AS sxx, regr_syy(ret, signal) AS syy, regr_sxy(ret, signal) AS sxy"


@query(f"""WITH {FACTS}, g AS (SELECT days, {_FIT} FROM facts WHERE ret IS NOT NULL GROUP BY 1), e AS (SELECT *, sqrt((syy - sxy * sxy / nullif(sxx, 0)) / nullif(n - 2, 0) / nullif(sxx, 0)) AS se FROM g)
SELECT days, n, round(b, 6) AS slope, round(a, 6) AS intercept, round(se, 6) AS error, round(b - 1.959964 * se, 6) AS lower, round(b + 1.959964 * se, 6) AS upper, NOT (b - 1.959964 * se <= 0 AND b + 1.959964 * se >= 0) AS clear FROM e""")
def regression_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of returns by signal at each horizon, with the slope's 95 % interval."""
    g = facts(spark, sf_dir).where("ret IS NOT NULL").groupBy("days").agg(F.count("*").alias("n"), *[f("ret", "signal").alias(k) for k, f in (("b", F.regr_slope), ("a", F.regr_intercept), ("sxx", F.regr_sxx), ("syy", F.regr_syy), ("sxy", F.regr_sxy))])
    se = F.sqrt(F.try_divide(F.try_divide(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.col("n") - 2), F.col("sxx")))
    g = g.withColumn("se", se)
    low, high = F.col("b") - 1.959964 * F.col("se"), F.col("b") + 1.959964 * F.col("se")
    return g.select("days", "n", F.round("b", 6).alias("slope"), F.round("a", 6).alias("intercept"), F.round("se", 6).alias("error"), F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"), (~((low <= 0) & (high >= 0))).alias("clear"))


@query(f"""WITH {ARTICLES}, as_of AS (SELECT max(date) AS d FROM articles), w AS (SELECT asset, signal, exp(-date_diff('day', date, d) / 30.0) AS weight FROM articles, as_of)
SELECT asset, count(*) AS n, round(sum(weight), 6) AS weight, round(sum(weight * signal) / sum(weight), 6) AS decayed_signal, round(avg(signal), 6) AS mean_signal FROM w GROUP BY 1""")
def decayed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's signals, the weight of each falling with its age by e in thirty days."""
    a = articles(spark, sf_dir)
    as_of = a.agg(F.max("date").alias("d"))
    w = F.exp(-F.datediff("d", "date") / 30.0)
    return a.crossJoin(F.broadcast(as_of)).groupBy("asset").agg(F.count("*").alias("n"), F.round(F.sum(w), 6).alias("weight"), F.round(F.sum(w * F.col("signal")) / F.sum(w), 6).alias("decayed_signal"), F.round(F.avg("signal"), 6).alias("mean_signal"))


@query(f"""WITH {FACTS}, p AS (SELECT asset, days, (signal - 0.3) * CASE bias WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS predicted, ret FROM facts WHERE ret IS NOT NULL)
SELECT asset, days, count(*) AS n, round(avg(abs(predicted - ret)), 6) AS mean_gap, round(avg(predicted - ret), 6) AS bias, round(sqrt(avg((predicted - ret) * (predicted - ret))), 6) AS root_gap, round(corr(predicted, ret), 6) AS correlation FROM p GROUP BY 1, 2""")
def prediction_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far what signals and biases say lies from what returns then were."""
    b = F.col("bias")
    p = facts(spark, sf_dir).where("ret IS NOT NULL").select("asset", "days", ((F.col("signal") - 0.3) * F.when(b == "bullish", 1).when(b == "bearish", -1).otherwise(0)).alias("predicted"), "ret")
    gap = F.col("predicted") - F.col("ret")
    return p.groupBy("asset", "days").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(gap)), 6).alias("mean_gap"), F.round(F.avg(gap), 6).alias("bias"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("root_gap"), F.round(F.corr("predicted", "ret"), 6).alias("correlation"))


@query()
def return_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for the week's return, trained on three growing parts of the articles in order of date, judged on the next part each.

    A row for each part: error measures, and the mean confidence of its predictions, 0.6 of their size and 0.4 of the share
    of features that aren't zero.  No SQL: the trees are a model.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    from millrace.operators.carry import quantiles

    names = ["signal", "confidence", "side", "month", "weekday"]
    f = facts(spark, sf_dir).where("days = 7 AND ret IS NOT NULL").select("article_id", "date", "ret", "signal", "confidence", F.when(F.col("bias") == "bullish", 1.0).when(F.col("bias") == "bearish", -1.0).otherwise(0.0).alias("side"), F.month("date").cast("double").alias("month"), F.weekday("date").cast("double").alias("weekday"))
    f = f.withColumn("label", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "ret"))).withColumns({"all": F.lit(0), "day": F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double")})
    cuts = quantiles(f, "all", "day", {f"c{k}": k / 4 for k in (1, 2, 3)})
    f = f.join(F.broadcast(cuts), "all").withColumn("part", sum(((F.col("day") > F.col(f"c{k}")).cast("int") for k in (1, 2, 3)), F.lit(0)))
    f = VectorAssembler(inputCols=names, outputCol="features").transform(f).select("part", "label", "features")
    f = kept(f, "folds")
    out = None
    for part in (1, 2, 3):
        model = GBTRegressor(maxIter=30, maxDepth=3, stepSize=0.1, seed=1).fit(f.where(F.col("part") < part))
        p = model.transform(f.where(F.col("part") == part))
        x = vector_to_array("features")
        sure = 0.6 * F.least(F.lit(1.0), F.abs("prediction")) + 0.4 * F.size(F.filter(x, lambda v: v != 0)) / F.size(x)
        e = F.col("prediction") - F.col("label")
        row = p.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), (1 - F.sum(e * e) / (F.count("*") * F.var_pop("label"))).alias("r2"), F.avg(sure).alias("confidence"))
        row = row.select(F.lit(part).alias("part"), "*", *[F.lit(float(model.featureImportances[i])).alias(f"{k}_importance") for i, k in enumerate(names)])
        out = row if out is None else out.unionByName(row)
    return out
