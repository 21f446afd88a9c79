"""Verdicts that put other queries' parts together: overall quality, the whole article score, and predictions of stored models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scoring as S
from millrace.functions.validate import OVERALL
from millrace.operators.carry import cuts
from millrace.operators.models import fit_and_store, models, predictions
from millrace.plans.images import image_component, image_quality
from millrace.plans.registry import ORACLES, query
from millrace.plans.returns import facts
from millrace.plans.scores import SCORES, _scored
from millrace.plans.texts import quality_score
from millrace.plans.validation import article_validation, market_validation
from millrace.sources.scratch import fresh, kept

# Scores of articles without images or market data, and what makes an article valid.
NO_IMAGES, NO_MARKET = 50.0, 0.0
LEAST_QUALITY, LEAST_RELEVANCE = 40.0, 0.3
# End of fixed values.


@query(f"""WITH c AS ({ORACLES['quality_score']}), u AS ({ORACLES['article_validation']}), i AS ({ORACLES['image_quality']}), m AS ({ORACLES['market_validation']}),
p AS (SELECT c.doc_id, content_quality, relevance, coalesce(url_score, 0) AS url_score, coalesce(i.quality, {NO_IMAGES}) AS images, coalesce(m.quality, {NO_MARKET}) AS market, coalesce(errors, 'no record') AS errors
  FROM c LEFT JOIN u ON u.page_id = c.doc_id LEFT JOIN i ON i.article_id = c.doc_id LEFT JOIN m ON m.article_id = c.doc_id),
q AS (SELECT *, CASE WHEN errors <> '' THEN 0.0 ELSE {OVERALL['content']} * content_quality + {OVERALL['url']} * url_score + {OVERALL['images']} * images + {OVERALL['market']} * market + {OVERALL['relevance']} * relevance END AS quality FROM p)
SELECT doc_id, errors, CAST(url_score AS DOUBLE) AS url_score, CAST(images AS DOUBLE) AS images, CAST(market AS DOUBLE) AS market, round(CAST(quality AS DOUBLE) + 3.7e-7, 4) AS quality, errors = '' AND quality >= {LEAST_QUALITY} AND relevance >= {LEAST_RELEVANCE} AS is_valid FROM q""")
def overall_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validator's verdict on every article: five parts, weighted; one without images or market data has the parts' default, one with a broken record has none."""
    c, u = quality_score(spark, sf_dir).select("doc_id", "content_quality", "relevance"), article_validation(spark, sf_dir)
    i, m = image_quality(spark, sf_dir), market_validation(spark, sf_dir)
    p = c.join(u.select(F.col("page_id").alias("doc_id"), "url_score", "errors"), "doc_id", "left")
    p = p.join(i.select(F.col("article_id").alias("doc_id"), F.col("quality").alias("images")), "doc_id", "left").join(m.select(F.col("article_id").alias("doc_id"), F.col("quality").alias("market")), "doc_id", "left")
    p = p.na.fill({"url_score": 0.0, "images": NO_IMAGES, "market": NO_MARKET, "errors": "no record"})
    parts = {"content": "content_quality", "url": "url_score", "images": "images", "market": "market", "relevance": "relevance"}
    sound = F.col("errors") == ""
    p = p.withColumn("quality", F.when(sound, sum((F.col(parts[k]) * w for k, w in OVERALL.items()), F.lit(0.0))).otherwise(0.0))
    return p.select("doc_id", "errors", "url_score", "images", "market", F.round(F.col("quality") + 3.7e-7, 4).alias("quality"), (sound & (F.col("quality") >= LEAST_QUALITY) & (F.col("relevance") >= LEAST_RELEVANCE)).alias("is_valid"))


@query(f"""WITH {SCORES}, pictures AS ({ORACLES['image_component']}),
both_ AS (SELECT comps.* EXCLUDE (image, image_conf), coalesce(p.score, 0) AS image, coalesce(p.confidence, 0) AS image_conf FROM comps LEFT JOIN pictures p ON p.article_id = comps.user_id),
f AS (SELECT *, least(1.0, greatest(-1.0, 0.3 * text + 0.4 * image + 0.2 * market + 0.1 * meta)) AS score,
  greatest(0.0, least(1.0, 0.3 * text_conf + 0.4 * image_conf + 0.2 * market_conf + 0.1 * meta_conf - CASE WHEN text_conf < 0.3 THEN 0.2 ELSE 0 END - CASE WHEN image_conf < 0.3 THEN 0.3 ELSE 0 END)) AS confidence FROM both_)
SELECT event_id, round(CAST(image AS DOUBLE), 6) AS image, round(score + 3.7e-9, 6) AS score, round(confidence + 3.7e-9, 6) AS confidence FROM f""")
def full_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow_score with the image part that an article's images make; neutral, and without confidence, where it has none."""
    pictures = image_component(spark, sf_dir).select(F.col("article_id").alias("user_id"), F.col("score").alias("image"), F.col("confidence").alias("image_conf"))
    e = _scored(spark, sf_dir).drop("image", "image_conf", "score", "confidence").join(pictures, "user_id", "left").na.fill(0.0, ["image", "image_conf"])
    score, sure = S.weighted({k: F.col(k) for k in S.WEIGHTS}), S.confidence({k: F.col(f"{k}_conf") for k in S.WEIGHTS})
    return e.select("event_id", F.round("image", 6).alias("image"), F.round(score + 3.7e-9, 6).alias("score"), F.round(sure + 3.7e-9, 6).alias("confidence"))


@query()
def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five models fitted on the first four fifths of the articles by date, stored, read back, and applied to the rest, with the classifiers' consensus."""
    f = facts(spark, sf_dir).where("days = 7 AND ret IS NOT NULL").withColumns({"label": (F.col("ret") > 0).cast("double"), "day": F.datediff("date", F.lit("1970-01-01").cast("date"))})
    f = kept(f.select("article_id", "asset", "date", "day", "theme", "bias", "signal", "confidence", "ret", "label"), "records")
    last = F.broadcast(cuts(f, "day", {"last": 0.8}))
    f = f.join(last, F.lit(True))
    path, kinds = fresh(spark, "models"), models(trees=20)
    fit_and_store(kept(f.where("day <= last").drop("day", "last"), "train"), path, kinds)
    new = f.where("day > last").drop("day", "last", "label", "ret")
    out = predictions(spark, new, path, list(kinds))
    return out.select("article_id", "asset", "date", *[c for c in out.columns if c.startswith(("p_", "r_"))], "probability", "deviation", "agreement", "consensus", "advice")


@query()
def training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole training run, a row for each stage: collected, labelled, trained and stored, and validated on the last fifth of the time.

    A stage without rows fails, and those after it are skipped.
    """
    stages: list[tuple] = []

    def done(stage: str, rows: int, metric: str | None = None, value: float | None = None) -> bool:
        stages.append((stage, "success" if rows else "failed", rows, metric, value))
        return bool(rows)

    f = kept(facts(spark, sf_dir).where("days = 7").select("article_id", "asset", "date", "theme", "bias", "signal", "confidence", "ret"), "collected")
    if done("data_collection", f.count(), "assets", float(f.select("asset").distinct().count())):
        labelled = kept(f.where("ret IS NOT NULL").withColumns({"label": (F.col("ret") > 0).cast("double"), "day": F.datediff("date", F.lit("1970-01-01").cast("date"))}), "labelled")
        share = labelled.agg(F.avg("label")).first()[0]
        if done("label_generation", labelled.count(), "share_of_gains", share):
            last = cuts(labelled, "day", {"last": 0.8}).first().last
            train, test = kept(labelled.where(F.col("day") <= last).drop("day"), "train"), labelled.where(F.col("day") > last).drop("day")
            path, kinds = fresh(spark, "models"), {k: m for k, m in models(trees=10).items() if k in ("forest", "logistic")}
            if done("model_training", train.count(), "models", float(len(kinds))):
                fit_and_store(train, path, kinds)
                ok = F.avg(((F.col("probability") > 0.5) == (F.col("label") == 1)).cast("double"))
                m = predictions(spark, test, path, list(kinds)).agg(F.count("*").alias("n"), ok.alias("accuracy")).first()
                done("ensemble_validation", m.n, "accuracy", m.accuracy)
    for stage in ("data_collection", "label_generation", "model_training", "ensemble_validation")[len(stages):]:
        stages.append((stage, "skipped", 0, None, None))
    return spark.createDataFrame(stages, "stage string, status string, rows long, metric string, value double")
