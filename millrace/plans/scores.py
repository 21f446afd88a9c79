"""Article scores and alerts, back-tests, and classifiers with temporal splits."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import scoring as S
from millrace.functions import text as T
from millrace.functions.rolling import indicators
from millrace.operators.carry import cuts
from millrace.operators.simulate import LongCall, backtest, ordered_fold
from millrace.plans.registry import query
from millrace.sources.scratch import kept
from millrace.tables import daily, load

DIRECTION = "CASE WHEN user_id % 3 = 0 THEN 'bullish' WHEN user_id % 3 = 1 THEN 'bearish' ELSE 'neutral' END"
TITLE = "CASE WHEN event_id % 7 = 0 THEN 'Breaking: ' || event_type ELSE 'Notes on flows' END"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    i, length = F.col("event_id"), F.col("event_id") % 4000
    title = F.when(i % 7 == 0, F.concat(F.lit("Breaking: "), F.col("event_type"))).otherwise("Notes on flows")
    direction = F.when(F.col("user_id") % 3 == 0, "bullish").when(F.col("user_id") % 3 == 1, "bearish").otherwise("neutral")
    market, market_conf = S.market_component(F.when(i % 5 != 0, (F.col("value") - 10) / 100))
    meta, meta_conf = S.meta_component(F.col("ts"), title, length, F.col("event_type"))
    e = e.withColumns({"text": S.text_component(direction, i % 4, i % 3, i % 2 == 0), "image": ((i % 21) - 10) / 10.0, "market": market, "meta": meta, "text_conf": (i % 11) / 10.0, "image_conf": (i % 10) / 10.0, "market_conf": market_conf, "meta_conf": meta_conf})
    return e.withColumns({"score": S.weighted({k: F.col(k) for k in S.WEIGHTS}), "confidence": S.confidence({k: F.col(f"{k}_conf") for k in S.WEIGHTS})})


SCORES = f"""parts AS (SELECT event_id, event_type AS asset, ts, user_id,
  least(1.0, greatest(-1.0, CASE {DIRECTION} WHEN 'bullish' THEN 0.6 WHEN 'bearish' THEN -0.6 ELSE 0 END * least(1.0, (event_id % 4 + event_id % 3) * 0.1 + 0.7) * CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.8 END)) AS text,
  ((event_id % 21) - 10) / 10.0 AS image, CASE WHEN event_id % 5 <> 0 THEN (value - 10) / 100 END AS r, event_id % 4000 AS len, {TITLE} AS title, (event_id % 11) / 10.0 AS text_conf, (event_id % 10) / 10.0 AS image_conf FROM events),
comps AS (SELECT *, CASE WHEN r > 0.05 THEN 0.6 WHEN r < -0.05 THEN -0.6 WHEN r > 0.02 THEN 0.3 WHEN r < -0.02 THEN -0.3 ELSE 0 END AS market, CASE WHEN r IS NOT NULL THEN 0.8 ELSE 0.2 END AS market_conf,
  CASE WHEN isodow(ts) >= 6 THEN 0.1 ELSE 0 END + CASE WHEN hour(ts) BETWEEN 9 AND 16 THEN 0.1 ELSE 0 END + CASE WHEN title LIKE 'Breaking%' THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(title), asset) THEN 0.1 ELSE 0 END + CASE WHEN len > 2000 THEN 0.05 ELSE 0 END AS meta,
  0.5 + CASE WHEN len > 2000 THEN 0.1 WHEN len < 500 THEN -0.1 ELSE 0 END AS meta_conf FROM parts),
scores AS (SELECT *, least(1.0, greatest(-1.0, 0.3 * text + 0.4 * image + 0.2 * market + 0.1 * meta)) AS score,
  greatest(0.0, least(1.0, 0.3 * text_conf + 0.4 * image_conf + 0.2 * market_conf + 0.1 * meta_conf - CASE WHEN text_conf < 0.3 THEN 0.2 ELSE 0 END - CASE WHEN image_conf < 0.3 THEN 0.3 ELSE 0 END)) AS confidence FROM comps)"""
LEVEL = "CASE WHEN confidence >= 0.7 AND abs(score) >= 0.5 THEN 'extreme' WHEN confidence >= 0.7 AND abs(score) >= 0.3 THEN 'significant' ELSE 'info' END"


@query(f"WITH {SCORES} SELECT event_id, round(text, 6) AS text, round(market, 6) AS market, round(meta, 6) AS meta, round(score, 6) AS score, round(confidence, 6) AS confidence FROM scores")
def flow_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(c) for c in ("text", "market", "meta", "score", "confidence")])


@query(f"""WITH {SCORES}, r AS (SELECT *, round(score, 9) AS s9, round(confidence, 9) AS c9 FROM scores)
SELECT asset, {LEVEL.replace('confidence', 'c9').replace('score', 's9')} AS level, count(*) AS n, round(avg(score), 6) AS mean_score, round(max(abs(score)), 6) AS strongest,
  count(*) FILTER (score > 0.1) AS bullish, count(*) FILTER (score < -0.1) AS bearish FROM r GROUP BY 1, 2""")
def alert_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = F.col("score"), F.col("confidence")
    level = S.alert_level(F.round(s, 9), F.round(c, 9))
    return _scored(spark, sf_dir).groupBy(F.col("event_type").alias("asset"), level.alias("level")).agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean_score"), F.round(F.max(F.abs(s)), 6).alias("strongest"), F.count_if(s > 0.1).alias("bullish"), F.count_if(s < -0.1).alias("bearish"))


BASE = {"text": 0.30, "image": 0.25, "market": 0.25, "meta": 0.20}


def _factor(c: str) -> str:
    return f"CASE WHEN {c} >= 0.8 THEN 1.3 WHEN {c} >= 0.6 THEN 1.0 WHEN {c} >= 0.4 THEN 0.7 ELSE 0.5 END"


@query(f"""WITH {SCORES}, f AS (SELECT event_id, {', '.join(f'{w} * {_factor(f"{k}_conf")} AS {k}' for k, w in BASE.items())} FROM scores)
SELECT event_id, {', '.join(f'round({k} / ({" + ".join(BASE)}), 6) AS {k}_weight' for k in BASE)} FROM f""")
def adaptive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.adaptive_weights(BASE, {k: F.col(f"{k}_conf") for k in BASE})
    return _scored(spark, sf_dir).select("event_id", *[F.round(v, 6).alias(f"{k}_weight") for k, v in w.items()])


def alert_step(state: dict, row: dict, most: int = 10, cooldown: int = 300) -> dict:
    """Whether an alert is sent: at most ten in a clock hour, and five minutes between alerts of one signature."""
    t, hour = row["t"], row["t"] // 3600
    if hour != state["hour"]:
        state["hour"], state["sent"] = hour, 0
    ok = state["sent"] < most and t - state["last"].get(row["signature"], -cooldown) >= cooldown
    if ok:
        state["sent"] += 1
        state["last"][row["signature"]] = t
        for k in [k for k, v in state["last"].items() if t - v > 3600]:
            del state["last"][k]
    return {"asset": row["asset"], "event_id": row["event_id"], "signature": row["signature"], "sent": ok}


def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).where((F.abs(F.round("score", 9)) >= S.SIGNIFICANT) & (F.round("confidence", 9) >= 0.3))
    return s.select(F.col("event_type").alias("asset"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.concat_ws("_", "event_type", F.round("score", 1).cast("string")).alias("signature"))


@query()
def alert_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts that the limits let through, in order of time."""
    return limited_alerts(alert_rows(spark, sf_dir))


def limited_alerts(rows: DataFrame, cooldown: int = 300) -> DataFrame:
    """alert_step over (asset, event_id, t, signature), channel by channel.

    Nothing is carried into an hour that begins a cool-down or more after the last alert before it: there a channel is cut, and the
    pieces are folded by tasks of their own.
    """
    rows = kept(rows, "alerts").withColumn("hour", F.floor(F.col("t") / 3600))
    hours = rows.groupBy("asset", "hour").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    by_hour = W.partitionBy("asset").orderBy("hour")  # a row for each hour of a channel
    starts = F.coalesce(F.col("first") - F.lag("last").over(by_hour) >= cooldown, F.lit(True)).cast("long")
    pieces = hours.withColumn("starts", starts).select(F.col("asset").alias("a"), F.col("hour").alias("h"), F.sum("starts").over(by_hour.rowsBetween(W.unboundedPreceding, 0)).alias("piece"))
    cut = rows.join(pieces, F.col("asset").eqNullSafe(F.col("a")) & (F.col("hour") == F.col("h"))).select("asset", "event_id", "t", "signature", F.concat_ws("@", "asset", F.col("piece").cast("string")).alias("key"))
    return ordered_fold(cut, "key", ["t", "event_id"], lambda state, row: alert_step(state, row, cooldown=cooldown), {"hour": -1, "sent": 0, "last": {}}, "asset string, event_id long, signature string, sent boolean")


_SLIDING = """SELECT event_type AS asset, event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour,
  count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS last_day FROM events"""


def sliding(events: DataFrame, bucket_us: int = 86_400_000_000) -> DataFrame:
    """Of each event, how many of its type came in the hour and in the day up to it.

    An event adds one when it comes and takes it back when its hour and its day are over, so that running sums are the counts: work
    grows with the events and not with how many of them an hour holds.  Types are worked on day by day; each day starts with one row
    of what the day before leaves it.  Events without a time count one another.
    """
    day = lambda us: F.floor(us / bucket_us)
    us, hour_us, day_us = F.col("us"), 3_600_000_000, 86_400_000_000
    e = events.select(F.col("event_type").alias("asset"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("day", day(us))
    row = lambda asset, d, at, h, n: [F.col(asset).alias("asset"), d.alias("day"), at.alias("us"), h.cast("long").alias("h"), n.cast("long").alias("n")]
    own = e.select(*row("asset", F.col("day"), us, F.lit(1), F.lit(1)), "event_id", F.lit(True).alias("own"))
    one, none = F.lit(1), F.lit(0)
    over = lambda span, h, n: e.select("asset", "day", (us + span + 1).alias("us")).select(*row("asset", day(us), us, h, n), F.col("day").alias("of"))
    hours, days_ = over(hour_us, -one, none), over(day_us, none, -one)
    # What is taken back in a later day than it was added in has to be there when that day starts.
    left = e.groupBy("asset", "day").agg(F.count("*").alias("n"), F.count_if(day(us + hour_us + 1) > F.col("day")).alias("h")).where("day IS NOT NULL")
    starts = left.select(*row("asset", F.col("day") + 1, (F.col("day") + 1) * bucket_us, F.col("h"), F.col("n")))
    ends = hours.unionByName(days_).where("day - of <= 1").drop("of")
    both = own.unionByName(ends.unionByName(starts), allowMissingColumns=True)
    w = W.partitionBy("asset", "day").orderBy("us").rangeBetween(W.unboundedPreceding, 0)
    return both.withColumns({"last_hour": F.sum("h").over(w), "last_day": F.sum("n").over(w)}).where("own").select("asset", "event_id", "last_hour", "last_day")


@query(_SLIDING)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(load(spark, sf_dir, "events"))


@query(_SLIDING)
def sliding_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as sliding_counts, under its former name."""
    return sliding(load(spark, sf_dir, "events"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily contexts of a back-test, with the volatility regime."""
    x = indicators(daily(spark, sf_dir)).where("volatility_30d IS NOT NULL")
    # The tables' prices move far more than any market's: volatility is taken on a scale where regimes occur.
    vol = F.col("volatility_30d") / 100
    regime = F.when(vol >= 100, "extreme").when(vol >= 75, "high").when(vol >= 40, "normal").when(vol >= 20, "low").otherwise("very_low")
    return x.select("asset", "date", "close", vol.alias("volatility"), regime.alias("vol_regime"), F.col("distance_to_support"))


STRATEGIES = {"base": LongCall(target=50_000.0, stop=-20_000.0), "jitter1": LongCall(target=50_000.0, stop=-20_000.0).jittered(123), "short": LongCall(days=14, target=20_000.0, stop=-10_000.0)}


@query()
def backtest_long_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of three parameter sets on every asset."""
    return backtest(contexts(spark, sf_dir), STRATEGIES)


@query()
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades, wins, total, draw-down, Sharpe ratio and return on premium of each back-test."""
    t = backtest(contexts(spark, sf_dir), STRATEGIES)
    w = W.partitionBy("asset", "params").orderBy("exit_date", "entry_date").rowsBetween(W.unboundedPreceding, 0)
    c = t.withColumn("total", F.sum("pnl").over(w)).withColumn("high", F.max("total").over(w))
    return c.groupBy("asset", "params").agg(
        F.count("*").alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.sum("pnl").alias("pnl"), F.max(F.col("high") - F.col("total")).alias("max_drawdown"),
        (F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.try_divide(F.sum("pnl"), F.sum(F.abs("premium"))).alias("return_on_premium"))


# ---- classifiers

FEATURES = ["n_chars", "n_words", "mean_word", "capital", "symbols", "lines"]


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with text features and `fold`: five parts in order of id, the stand-in for time."""
    t = F.coalesce(F.col("text"), F.lit(""))
    w = T.word_list(T.plain(t))
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("label"), F.length(t).cast("double").alias("n_chars"), F.size(w).cast("double").alias("n_words"),
        F.coalesce(F.try_divide(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), F.size(w)), F.lit(0.0)).alias("mean_word"),
        F.coalesce(F.try_divide(F.length(t) - F.length(F.translate(t, T.UPPER, "")), F.length(t)), F.lit(0.0)).alias("capital"),
        F.coalesce(F.try_divide(F.length(t) - F.length(F.translate(t, "#*$%&|<>!", "")), F.length(t)), F.lit(0.0)).alias("symbols"),
        F.size(F.split(t, "\n")).cast("double").alias("lines"))
    at = cuts(d, "doc_id", {f"c{i}": i / 5 for i in range(1, 5)}).select(F.array("c1", "c2", "c3", "c4").alias("c"))
    return d.join(F.broadcast(at), F.lit(True), "left").withColumn("fold", F.size(F.filter("c", lambda x: x < F.col("doc_id")))).drop("c")


@query("""WITH d AS (SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT quantile_cont(doc_id, 0.2) AS a, quantile_cont(doc_id, 0.4) AS b, quantile_cont(doc_id, 0.6) AS c, quantile_cont(doc_id, 0.8) AS e FROM d)
SELECT CAST((a < doc_id)::INT + (b < doc_id)::INT + (c < doc_id)::INT + (e < doc_id)::INT AS INTEGER) AS fold, count(*) AS n, sum(quality)::BIGINT AS good FROM d, c GROUP BY 1""")
def temporal_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered parts: what comes first trains, what comes later tests."""
    return dataset(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("good"))


def evaluate(predicted: DataFrame, name: str) -> DataFrame:
    """One row of accuracy, precision, recall and F1 of (label, prediction)."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    hit_, said, are = F.count_if(y & p), F.count_if(p), F.count_if(y)
    m = predicted.agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"), F.try_divide(hit_, said).alias("precision"), F.try_divide(hit_, are).alias("recall"))
    return m.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(F.lit(name).alias("model"), "*")


@query()
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees, a forest and a logistic regression, trained on the first four parts and judged on the last.

    Rows are weighted so that the classes balance; scaling is fitted on the training rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    d = dataset(spark, sf_dir)
    share = d.where("fold < 4").agg(F.avg("label")).first()[0]
    share = min(max(share if share is not None else 0.5, 0.01), 0.99)
    d = d.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    d = kept(d, "folds")
    train, test = d.where("fold < 4"), d.where("fold = 4")
    models = {"boosted_trees": GBTClassifier(maxIter=100, maxDepth=4, stepSize=0.1, weightCol="weight", seed=1), "forest": RandomForestClassifier(numTrees=100, maxDepth=8, weightCol="weight", seed=1), "logistic": LogisticRegression(weightCol="weight")}
    out = None
    for name, model in models.items():
        steps = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model]
        row = evaluate(Pipeline(stages=steps).fit(train).transform(test), name)
        out = row if out is None else out.unionByName(row)
    return out


@query()
def monthly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's months, grouped by return and volatility."""
    from pyspark.ml.clustering import KMeans

    from millrace.plans.frames import regimes

    m = regimes(spark, sf_dir).where("ret IS NOT NULL AND vol IS NOT NULL")
    v = VectorAssembler(inputCols=["ret", "vol"], outputCol="raw").transform(m)
    v = StandardScaler(inputCol="raw", outputCol="features").fit(v).transform(v)
    return KMeans(k=3, seed=1).fit(v).transform(v).select("asset", "period", "ret", "vol", F.col("prediction").alias("cluster"))
