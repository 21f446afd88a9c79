"""What articles' content and prices say together: weekly metrics, contexts by date, labels, features, consensus and strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.rolling import indicators
from millrace.operators.asof import ahead
from millrace.plans.registry import query
from millrace.plans.returns import FACTS, event_returns, facts
from millrace.tables import ARTICLES, DAILY, articles, daily

# ---- the week after an article

SLICES = f"""{DAILY}, {ARTICLES}, moved AS (SELECT *, (close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY date), 0) - 1) * 100 AS change FROM daily),
wanted AS (SELECT DISTINCT asset, date FROM articles),
slice AS (SELECT w.asset, w.date, p.date AS day, p.high, p.low, p.close, p.change, lag(p.close) OVER s AS before, max(p.close) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM wanted w JOIN moved p ON p.asset = w.asset AND p.date BETWEEN w.date AND w.date + 7 WINDOW s AS (PARTITION BY w.asset, w.date ORDER BY p.date)),
weeks AS (SELECT asset, date, arg_min(close, day) AS first, arg_max(close, day) AS last, max(high) AS high, min(low) AS low, coalesce(stddev_samp(CASE WHEN before > 0 THEN close / before - 1 WHEN before IS NOT NULL THEN 0 END), 0) AS vol,
  max(CASE WHEN peak > 0 THEN (peak - close) / peak ELSE 0 END) AS mdd, count(*) FILTER (abs(change) > 5) AS big_moves, count(*) FILTER (change > 5) AS big_rises FROM slice GROUP BY 1, 2),
rated AS (SELECT a.article_id, a.asset, a.date, a.bias, a.confidence, w.first, w.last, w.high, w.low, w.vol, w.mdd, w.big_moves, w.big_rises, CASE WHEN w.first > 0 THEN (w.last - w.first) / w.first ELSE 0 END AS r FROM articles a JOIN weeks w ON w.asset = a.asset AND w.date = a.date),
base AS (SELECT *, CASE WHEN bias = 'bullish' AND r > 0 THEN least(0.7 + r * 2, 1.0) WHEN bias = 'bearish' AND r < 0 THEN least(0.7 + abs(r) * 2, 1.0) WHEN bias = 'neutral' AND abs(r) < 0.05 THEN 0.8
  WHEN bias = 'bullish' AND r < -0.05 THEN 0.2 WHEN bias = 'bearish' AND r > 0.05 THEN 0.2 ELSE 0.4 END AS b FROM rated),
weekly AS (SELECT *, least(1.0, greatest(0.0, b * confidence + 0.5 * (1 - confidence))) AS accuracy FROM base)"""


def prediction_accuracy(bias: Column, ret: Column, confidence: Column) -> Column:
    """0 to 1: how well a bias told the week's return, drawn to a half where the confidence is small."""
    base = (
        F.when((bias == "bullish") & (ret > 0), F.least(0.7 + ret * 2, F.lit(1.0)))
        .when((bias == "bearish") & (ret < 0), F.least(0.7 + F.abs(ret) * 2, F.lit(1.0)))
        .when((bias == "neutral") & (F.abs(ret) < 0.05), 0.8)
        .when((bias == "bullish") & (ret < -0.05), 0.2)
        .when((bias == "bearish") & (ret > 0.05), 0.2)
        .otherwise(0.4)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * confidence + 0.5 * (1 - confidence)))


def weekly_metrics(arts: DataFrame, prices: DataFrame) -> DataFrame:
    """Articles with the seven days after them: first and last close, range, return, deviation, draw-down and large daily moves.

    Worked out once for each asset and date.
    """
    days = W.partitionBy("asset").orderBy("date")
    moved = prices.withColumn("change", (F.try_divide("close", F.lag("close").over(days)) - 1) * 100)
    found = ahead(arts.select("asset", "date").distinct(), moved, "asset", "date", F.lit(7), 7)
    s = W.partitionBy("asset", "date").orderBy("p_date")
    close = F.col("p_close")
    found = found.withColumns({"before": F.lag("p_close").over(s), "peak": F.max("p_close").over(s.rowsBetween(W.unboundedPreceding, 0))})
    step = F.when(F.col("before") > 0, close / F.col("before") - 1).when(F.col("before").isNotNull(), 0.0)
    fall = F.when(F.col("peak") > 0, (F.col("peak") - close) / F.col("peak")).otherwise(0.0)
    weeks = found.groupBy("asset", "date").agg(
        F.min_by("p_close", "p_date").alias("first"), F.max_by("p_close", "p_date").alias("last"), F.max("p_high").alias("high"), F.min("p_low").alias("low"),
        F.coalesce(F.stddev_samp(step), F.lit(0.0)).alias("vol"), F.max(fall).alias("mdd"), F.count_if(F.abs("p_change") > 5).alias("big_moves"), F.count_if(F.col("p_change") > 5).alias("big_rises"))
    rated = arts.join(weeks, ["asset", "date"]).withColumn("r", F.when(F.col("first") > 0, (F.col("last") - F.col("first")) / F.col("first")).otherwise(0.0))
    return rated.withColumn("accuracy", prediction_accuracy(F.col("bias"), F.col("r"), F.col("confidence")))


@query(f"""WITH {SLICES} SELECT article_id, asset, first, last, high, low, round(r, 6) AS weekly_return, round(vol, 6) AS volatility, round(mdd, 6) AS max_drawdown, big_moves, big_rises,
  CASE WHEN r > 0.05 THEN 'up' WHEN r < -0.05 THEN 'down' ELSE 'sideways' END AS trend, CASE WHEN vol > 0.05 THEN 'high' WHEN vol > 0.02 THEN 'medium' ELSE 'low' END AS vol_level, round(accuracy, 6) AS accuracy FROM weekly""")
def weekly_price_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, r, v = weekly_metrics(articles(spark, sf_dir), daily(spark, sf_dir)), F.col("r"), F.col("vol")
    return m.select(
        "article_id", "asset", "first", "last", "high", "low", F.round(r, 6).alias("weekly_return"), F.round(v, 6).alias("volatility"), F.round("mdd", 6).alias("max_drawdown"), "big_moves", "big_rises",
        F.when(r > 0.05, "up").when(r < -0.05, "down").otherwise("sideways").alias("trend"), F.when(v > 0.05, "high").when(v > 0.02, "medium").otherwise("low").alias("vol_level"), F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {SLICES} SELECT count(*) AS n, round(avg(accuracy), 6) AS accuracy, {', '.join(f"round(coalesce(avg(accuracy) FILTER (bias = '{b}'), 0), 6) AS {b}_accuracy, count(*) FILTER (bias = '{b}') AS {b}" for b in ('bullish', 'bearish', 'neutral'))},
  round(avg(CASE WHEN accuracy > 0.6 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(r), 6) AS mean_return, round(avg(vol), 6) AS mean_volatility FROM weekly""")
def correlation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over all articles and by bias, hit rate, mean return and deviation of the weeks after them."""
    m, acc = weekly_metrics(articles(spark, sf_dir), daily(spark, sf_dir)), F.col("accuracy")
    parts = [x for b in ("bullish", "bearish", "neutral") for x in (F.round(F.coalesce(F.avg(F.when(F.col("bias") == b, acc)), F.lit(0.0)), 6).alias(f"{b}_accuracy"), F.count_if(F.col("bias") == b).alias(b))]
    return m.agg(F.count("*").alias("n"), F.round(F.avg(acc), 6).alias("accuracy"), *parts, F.round(F.avg((acc > 0.6).cast("double")), 6).alias("hit_rate"), F.round(F.avg("r"), 6).alias("mean_return"), F.round(F.avg("vol"), 6).alias("mean_volatility"))


# ---- content and prices by date

CONTENT = f"""{DAILY}, {ARTICLES},
content AS (SELECT date, count(*) AS n, count(*) FILTER (article_id % 4 <> 0) AS articles, count(*) FILTER (article_id % 4 = 0) AS images, avg(confidence) AS mean_confidence, count(*) FILTER (confidence >= 0.7) AS sure FROM articles GROUP BY 1),
priced AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r, close / nullif(lag(close, 7) OVER w, 0) - 1 AS r7 FROM daily WINDOW w AS (PARTITION BY asset ORDER BY date)),
vols AS (SELECT *, CASE WHEN count(r) OVER w = 30 THEN stddev_samp(r) OVER w * sqrt(365.0) END AS vol FROM priced WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 29 PRECEDING)),
contexts AS (SELECT c.date, v.asset, n, articles, images, mean_confidence, sure, r, r7, vol, CAST(least(1.0, least(n * 0.2, 1.0) + least(sure * 0.3, 0.5)) AS DOUBLE) AS strength,
  CASE WHEN r * 100 > 2 THEN 'bullish_price' WHEN r * 100 < -2 THEN 'bearish_price' ELSE 'neutral' END AS alignment, least(n / 5.0, 1.0) * CASE WHEN vol IS NULL THEN 0.5 ELSE least(vol / 100, 1.0) END AS impact FROM content c JOIN vols v ON v.date = c.date)"""


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per date and asset: how much content names the date, the price's change and deviation, and what both make together."""
    a = articles(spark, sf_dir)
    image = F.col("article_id") % 4 == 0
    content = a.groupBy("date").agg(F.count("*").alias("n"), F.count_if(~image).alias("articles"), F.count_if(image).alias("images"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") >= 0.7).alias("sure"))
    days = W.partitionBy("asset").orderBy("date")
    p = indicators(daily(spark, sf_dir)).withColumns({"r": F.col("return_1d"), "r7": F.try_divide("close", F.lag("close", 7).over(days)) - 1, "vol": F.col("volatility_30d") / 100})
    x = content.join(p.select("date", "asset", "r", "r7", "vol"), "date")
    n, r = F.col("n"), F.col("r") * 100
    strength = F.least(F.lit(1.0), F.least(n * 0.2, F.lit(1.0)) + F.least(F.col("sure") * 0.3, F.lit(0.5)))
    impact = F.least(n / 5.0, F.lit(1.0)) * F.when(F.col("vol").isNull(), 0.5).otherwise(F.least(F.col("vol") / 100, F.lit(1.0)))
    return x.withColumns({"strength": strength, "alignment": F.when(r > 2, "bullish_price").when(r < -2, "bearish_price").otherwise("neutral"), "impact": impact})


@query(f"WITH {CONTENT} SELECT date, asset, n, articles, images, round(mean_confidence, 6) AS mean_confidence, sure, round(strength, 6) AS strength, alignment, round(impact, 6) AS impact FROM contexts")
def content_price_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("date", "asset", "n", "articles", "images", F.round("mean_confidence", 6).alias("mean_confidence"), "sure", F.round("strength", 6).alias("strength"), "alignment", F.round("impact", 6).alias("impact"))


@query(f"""WITH {CONTENT}, c AS (SELECT *, round(strength, 9) AS s FROM contexts) SELECT count(*) AS n, count(DISTINCT date) AS dates, count(*) FILTER (articles > 0) AS with_articles, count(*) FILTER (images > 0) AS with_images, round(avg(strength), 6) AS mean_strength, round(avg(impact), 6) AS mean_impact,
  min(date) AS first_date, max(date) AS last_date, CAST(date_diff('day', min(date), max(date)) AS INTEGER) AS span_days, count(*) FILTER (s >= 0.7) AS high, count(*) FILTER (s >= 0.4 AND s < 0.7) AS medium, count(*) FILTER (s < 0.4) AS low FROM c""")
def content_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contexts in one row: counts, means, dates covered and three tiers of strength."""
    s = F.round("strength", 9)
    return contexts(spark, sf_dir).agg(
        F.count("*").alias("n"), F.countDistinct("date").alias("dates"), F.count_if(F.col("articles") > 0).alias("with_articles"), F.count_if(F.col("images") > 0).alias("with_images"), F.round(F.avg("strength"), 6).alias("mean_strength"), F.round(F.avg("impact"), 6).alias("mean_impact"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.datediff(F.max("date"), F.min("date")).alias("span_days"), F.count_if(s >= 0.7).alias("high"), F.count_if((s >= 0.4) & (s < 0.7)).alias("medium"), F.count_if(s < 0.4).alias("low"))


@query(f"WITH {CONTENT} SELECT date, asset, round(strength, 6) AS strength, alignment, articles > 0 AS has_articles, images > 0 AS has_images FROM contexts ORDER BY round(strength, 9) DESC, date, asset LIMIT 5")
def top_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest contexts; of equals the earliest."""
    c = contexts(spark, sf_dir).orderBy(F.desc(F.round("strength", 9)), "date", "asset").limit(5)
    return c.select("date", "asset", F.round("strength", 6).alias("strength"), "alignment", (F.col("articles") > 0).alias("has_articles"), (F.col("images") > 0).alias("has_images"))


_STRATEGIES = """CASE WHEN vol_regime IN ('high', 'extreme') THEN CASE WHEN market = 'volatile' THEN 'short_straddle iron_condor' ELSE 'long_straddle long_strangle' END WHEN vol_regime = 'low' THEN 'long_options calendar_spreads' END,
  CASE WHEN bias = 'bullish' THEN 'long_calls bull_spreads' WHEN bias = 'bearish' THEN 'long_puts bear_spreads' END"""


@query(f"""WITH {CONTENT}, spine AS (SELECT DISTINCT v.asset, CAST(d AS DATE) AS date FROM vols v, (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM daily)),
known AS (SELECT s.asset, s.date, v.date AS as_of, v.close, v.r7 * 100 AS change_7d, v.vol FROM spine s ASOF LEFT JOIN vols v ON v.asset = s.asset AND v.date <= s.date),
charts AS (SELECT date, CASE WHEN count(*) FILTER (bias = 'bullish') > count(*) FILTER (bias = 'bearish') THEN 'bullish' WHEN count(*) FILTER (bias = 'bearish') > count(*) FILTER (bias = 'bullish') THEN 'bearish' ELSE 'neutral' END AS chart FROM articles WHERE article_id % 4 = 0 GROUP BY 1),
regimes AS (SELECT k.*, coalesce(chart, 'none') AS chart, CASE WHEN vol >= 100 THEN 'extreme' WHEN vol >= 75 THEN 'high' WHEN vol >= 40 THEN 'normal' WHEN vol >= 20 THEN 'low' WHEN vol IS NOT NULL THEN 'very_low' ELSE 'unknown' END AS vol_regime,
  CASE WHEN vol > 80 THEN 'volatile' WHEN change_7d > 5 THEN 'bull' WHEN change_7d < -5 THEN 'bear' ELSE 'sideways' END AS market FROM known k LEFT JOIN charts c ON c.date = k.date),
votes AS (SELECT *, CAST(coalesce(change_7d > 5, false) AS INT) + CAST(chart = 'bullish' AS INT) + CAST(market = 'bull' AS INT) AS up, CAST(coalesce(change_7d < -5, false) AS INT) + CAST(chart = 'bearish' AS INT) + CAST(market = 'bear' AS INT) AS down FROM regimes),
biased AS (SELECT *, CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END AS bias FROM votes)
SELECT asset, date, as_of, round(change_7d, 4) AS change_7d, chart, vol_regime, market, bias, concat_ws(' ', {_STRATEGIES}) AS strategies FROM biased""")
def unified_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every asset and day of the whole span: the last prices known by then, regimes, that day's charts, the bias they vote for, and strategies."""
    from millrace.operators.asof import last_before

    d = daily(spark, sf_dir)
    days = W.partitionBy("asset").orderBy("date")
    p = indicators(d).select("asset", "date", (F.col("volatility_30d") / 100).alias("vol"), ((F.try_divide("close", F.lag("close", 7).over(days)) - 1) * 100).alias("change_7d"))
    p = p.withColumn("x", F.struct(F.col("date").alias("as_of"), "change_7d", "vol")).withColumn("o", F.lit(0))
    start = d.agg(F.min("date").alias("d"), F.max("date").alias("last")).select(F.explode(F.sequence("d", "last")).alias("date"))
    spine = d.select("asset").distinct().crossJoin(start)
    known = last_before(spine, p, "asset", "date", "date", "x", "o").select("asset", "date", "x.*")
    bull, bear = F.count_if(F.col("bias") == "bullish"), F.count_if(F.col("bias") == "bearish")
    charts = articles(spark, sf_dir).where("article_id % 4 = 0").groupBy("date").agg(F.when(bull > bear, "bullish").when(bear > bull, "bearish").otherwise("neutral").alias("chart"))
    vol, c7 = F.col("vol"), F.col("change_7d")
    r = known.join(charts, "date", "left").na.fill("none", ["chart"]).withColumns({
        "vol_regime": F.when(vol >= 100, "extreme").when(vol >= 75, "high").when(vol >= 40, "normal").when(vol >= 20, "low").when(vol.isNotNull(), "very_low").otherwise("unknown"),
        "market": F.when(vol > 80, "volatile").when(c7 > 5, "bull").when(c7 < -5, "bear").otherwise("sideways")})
    vote = lambda change, chart, market: F.coalesce(change, F.lit(False)).cast("int") + (F.col("chart") == chart).cast("int") + (F.col("market") == market).cast("int")
    up, down = vote(c7 > 5, "bullish", "bull"), vote(c7 < -5, "bearish", "bear")
    r = r.withColumn("bias", F.when(up > down, "bullish").when(down > up, "bearish").otherwise("neutral"))
    tall = F.when(F.col("vol_regime").isin("high", "extreme"), F.when(F.col("market") == "volatile", "short_straddle iron_condor").otherwise("long_straddle long_strangle")).when(F.col("vol_regime") == "low", "long_options calendar_spreads")
    side = F.when(F.col("bias") == "bullish", "long_calls bull_spreads").when(F.col("bias") == "bearish", "long_puts bear_spreads")
    return r.select("asset", "date", "as_of", F.round(c7, 4).alias("change_7d"), "chart", "vol_regime", "market", "bias", F.concat_ws(" ", tall, side).alias("strategies"))


# ---- labels and features

def _event_returns_sql() -> str:
    from millrace.plans.registry import ORACLES

    return ORACLES["event_returns"]


LABELS = f"""er AS ({_event_returns_sql()}), combined AS (SELECT article_id, asset, ret_24h, ret_72h, CASE WHEN ret_24h IS NOT NULL AND ret_72h IS NOT NULL THEN 0.7 * ret_24h + 0.3 * ret_72h ELSE coalesce(ret_24h, ret_72h) END AS combined FROM er WHERE ret_24h IS NOT NULL OR ret_72h IS NOT NULL),
labelled AS (SELECT *, CASE WHEN combined > 0.02 THEN 1.0 WHEN combined < -0.02 THEN -1.0 ELSE 0.0 END AS label FROM combined WHERE abs(combined) >= 0.005)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a label from their returns after a day and after three: up, down or flat beyond 2 %; returns below half a percent go."""
    day, three = F.col("ret_24h"), F.col("ret_72h")
    c = event_returns(spark, sf_dir).withColumn("combined", F.when(day.isNotNull() & three.isNotNull(), 0.7 * day + 0.3 * three).otherwise(F.coalesce(day, three)))
    c = c.where(F.abs("combined") >= 0.005)
    return c.withColumn("label", F.when(F.col("combined") > 0.02, 1.0).when(F.col("combined") < -0.02, -1.0).otherwise(0.0))


@query(f"WITH {LABELS} SELECT article_id, asset, round(combined + 3.7e-9, 6) AS combined, CAST(label AS DOUBLE) AS label FROM labelled")
def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("article_id", "asset", F.round(F.col("combined") + 3.7e-9, 6).alias("combined"), "label")


@query(f"WITH {LABELS} SELECT label::DOUBLE AS label, asset, count(*) AS n, round(avg(combined), 6) AS mean, round(stddev_samp(combined), 6) AS sd, min(article_id) AS first_id, max(article_id) AS last_id FROM labelled GROUP BY 1, 2")
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("label", "asset").agg(F.count("*").alias("n"), F.round(F.avg("combined"), 6).alias("mean"), F.round(F.stddev_samp("combined"), 6).alias("sd"), F.min("article_id").alias("first_id"), F.max("article_id").alias("last_id"))


THEMES, BIASES = [f"theme{i}" for i in range(6)], ["bullish", "bearish", "neutral"]
_CLIPPED = "CASE WHEN signal < 0 THEN -1 ELSE 1 END * greatest(abs(signal), 1e-6)"


@query(f"""WITH {FACTS} SELECT article_id, days, signal AS feat_signal, confidence AS feat_confidence, round(coalesce(vol, 0), 6) AS feat_volatility, {', '.join(f"CAST(bias = '{b}' AS INTEGER) AS feat_bias_{b}" for b in BIASES)}, {', '.join(f"CAST(theme = '{t}' AS INTEGER) AS feat_{t}" for t in THEMES)},
  round(signal * confidence, 6) AS feat_interaction, round(vol / ({_CLIPPED}), 4) AS feat_ratio, CAST(month(date) AS INTEGER) AS feat_month, CAST(isodow(date) - 1 AS INTEGER) AS feat_weekday, CAST(quarter(date) AS INTEGER) AS feat_quarter,
  CASE WHEN ret > 0.02 THEN 1 WHEN ret < -0.02 THEN -1 ELSE 0 END AS target_direction, CAST(coalesce(ret > 0, false) AS INTEGER) AS target_profitable, round(ret / (vol + 1e-8), 4) AS target_risk_adjusted FROM facts WHERE days = 7""")
def engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and targets of each article's week: indicators of bias and theme, interaction, ratio with a guarded divisor, calendar."""
    s, v, r, d = F.col("signal"), F.col("vol"), F.col("ret"), F.col("date")
    clipped = F.when(s < 0, -1).otherwise(1) * F.greatest(F.abs(s), F.lit(1e-6))
    return facts(spark, sf_dir).where("days = 7").select(
        "article_id", "days", s.alias("feat_signal"), F.col("confidence").alias("feat_confidence"), F.round(F.coalesce(v, F.lit(0.0)), 6).alias("feat_volatility"), *[(F.col("bias") == b).cast("int").alias(f"feat_bias_{b}") for b in BIASES], *[(F.col("theme") == t).cast("int").alias(f"feat_{t}") for t in THEMES],
        F.round(s * F.col("confidence"), 6).alias("feat_interaction"), F.round(v / clipped, 4).alias("feat_ratio"), F.month(d).alias("feat_month"), F.weekday(d).alias("feat_weekday"), F.quarter(d).alias("feat_quarter"),
        F.when(r > 0.02, 1).when(r < -0.02, -1).otherwise(0).alias("target_direction"), F.coalesce(r > 0, F.lit(False)).cast("int").alias("target_profitable"), F.round(r / (v + 1e-8), 4).alias("target_risk_adjusted"))


@query(f"""WITH {ARTICLES} SELECT CAST(floor(quantile_cont(isodow(date) - 1, 0.5)) AS INTEGER) AS weekday, CAST(floor(quantile_cont(month(date), 0.5)) AS INTEGER) AS month, CAST(floor(quantile_cont(quarter(date), 0.5)) AS INTEGER) AS quarter FROM articles""")
def default_date_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The medians of weekday, month and quarter, for records without a date."""
    d = F.col("date")
    return articles(spark, sf_dir).agg(*[F.floor(F.median(f(d))).cast("int").alias(n) for n, f in (("weekday", F.weekday), ("month", F.month), ("quarter", F.quarter))])


# ---- consensus and risk of several models

PROBABILITIES = "least(1.0, signal) AS p1, confidence AS p2, (CASE bias WHEN 'bullish' THEN 0.8 WHEN 'bearish' THEN 0.2 ELSE 0.5 END) AS p3"


@query(f"""WITH {ARTICLES}, p AS (SELECT article_id, signal, confidence, theme, {PROBABILITIES} FROM articles),
m AS (SELECT *, list_avg([p1, p2, p3]) AS mean, list_stddev_pop([p1, p2, p3]) AS sd, CAST(p1 > 0.5 AS INT) + CAST(p2 > 0.5 AS INT) + CAST(p3 > 0.5 AS INT) AS up, CAST(abs(p1 - 0.5) < 0.1 AS INT) + CAST(abs(p2 - 0.5) < 0.1 AS INT) + CAST(abs(p3 - 0.5) < 0.1 AS INT) AS unsure FROM p),
a AS (SELECT *, CASE WHEN sd < 0.1 THEN 'high' WHEN sd < 0.2 THEN 'medium' ELSE 'low' END AS agreement, CASE WHEN signal < 0.3 THEN 0.2 ELSE 0 END + CASE WHEN confidence < 0.5 THEN 0.15 ELSE 0 END + CASE WHEN theme IN ('theme1', 'theme4') THEN 0.15 ELSE 0 END + CASE WHEN up IN (1, 2) THEN 0.25 ELSE 0 END + 0.1 * unsure AS risk FROM m)
SELECT article_id, round(mean + 3.7e-9, 6) AS probability, CASE WHEN mean > 0.5 THEN 'bullish' ELSE 'bearish' END AS consensus, agreement, CASE WHEN mean > 0.6 AND agreement = 'high' THEN 'strong_buy' WHEN mean < 0.4 AND agreement = 'high' THEN 'strong_sell' WHEN abs(mean - 0.5) > 0.1 THEN 'weak_signal' ELSE 'neutral' END AS advice,
  CAST(round(risk, 6) AS DOUBLE) AS risk, CASE WHEN risk > 0.6 THEN 'high' WHEN risk > 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM a""")
def model_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' probabilities as one: mean, agreement by deviation, advice, and a risk that adds up what speaks against it."""
    b = F.col("bias")
    p = [F.least(F.lit(1.0), F.col("signal")), F.col("confidence"), F.when(b == "bullish", 0.8).when(b == "bearish", 0.2).otherwise(0.5)]
    x = articles(spark, sf_dir).select("article_id", "signal", "confidence", "theme", F.array(*p).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda a, v: a + f(v))
    x = x.withColumn("mean", total(lambda v: v) / 3)
    count = lambda f: F.size(F.filter("p", f))
    x = x.withColumns({"sd": F.sqrt(total(lambda v: (v - F.col("mean")) * (v - F.col("mean"))) / 3), "up": count(lambda v: v > 0.5), "unsure": count(lambda v: F.abs(v - 0.5) < 0.1)})
    add = lambda c, k: F.when(c, k).otherwise(0.0)
    risk = add(F.col("signal") < 0.3, 0.2) + add(F.col("confidence") < 0.5, 0.15) + add(F.col("theme").isin("theme1", "theme4"), 0.15) + add(F.col("up").isin(1, 2), 0.25) + 0.1 * F.col("unsure")
    agreement = F.when(F.col("sd") < 0.1, "high").when(F.col("sd") < 0.2, "medium").otherwise("low")
    x = x.withColumns({"agreement": agreement, "risk": F.round(risk, 6)})
    m, high = F.col("mean"), F.col("agreement") == "high"
    advice = F.when((m > 0.6) & high, "strong_buy").when((m < 0.4) & high, "strong_sell").when(F.abs(m - 0.5) > 0.1, "weak_signal").otherwise("neutral")
    return x.select("article_id", F.round(m + 3.7e-9, 6).alias("probability"), F.when(m > 0.5, "bullish").otherwise("bearish").alias("consensus"), "agreement", advice.alias("advice"), "risk", F.when(F.col("risk") > 0.6, "high").when(F.col("risk") > 0.3, "medium").otherwise("low").alias("risk_level"))


# ---- strategies

CURVE = f"""{FACTS}, daily_pnl AS (SELECT date, avg(CASE bias WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END * ret) AS strategy, avg(ret) AS hold FROM facts WHERE days = 7 AND ret IS NOT NULL GROUP BY 1),
summed AS (SELECT date, strategy, hold, sum(strategy) OVER w AS total, sum(hold) OVER w AS held FROM daily_pnl WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT *, total - max(total) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS fall FROM summed)"""


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By date: the mean return of following each article's bias, of holding, their running sums, and the fall from the peak."""
    side = F.when(F.col("bias") == "bullish", 1).when(F.col("bias") == "bearish", -1).otherwise(0)
    pnl = facts(spark, sf_dir).where("days = 7 AND ret IS NOT NULL").groupBy("date").agg(F.avg(side * F.col("ret")).alias("strategy"), F.avg("ret").alias("hold"))
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # a row for each calendar day: few
    x = pnl.withColumns({"total": F.sum("strategy").over(w), "held": F.sum("hold").over(w)})
    return x.withColumn("fall", F.col("total") - F.max("total").over(w))


@query(f"WITH {CURVE} SELECT date, round(total, 6) AS strategy, round(held, 6) AS buy_and_hold, round(fall, 6) AS drawdown FROM curve")
def strategy_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve(spark, sf_dir).select("date", F.round("total", 6).alias("strategy"), F.round("held", 6).alias("buy_and_hold"), F.round("fall", 6).alias("drawdown"))


@query(f"""WITH {CURVE}, m AS (SELECT sum(strategy) AS total, avg(strategy) AS mean, avg(CASE WHEN strategy > 1e-9 THEN 1.0 ELSE 0 END) AS win_rate, avg(strategy) / nullif(stddev_pop(strategy), 0) * sqrt(52.0) AS sharpe, min(fall) AS mdd, sum(hold) AS held FROM curve)
SELECT round(total, 6) AS total, round(mean, 6) AS mean, round(win_rate, 6) AS win_rate, round(sharpe, 6) AS sharpe, round(mdd, 6) AS max_drawdown, round(held, 6) AS buy_and_hold, round(total - held, 6) AS excess,
  CASE WHEN -mdd > 0.2 THEN 'high' WHEN -mdd > 0.1 THEN 'medium' ELSE 'low' END AS risk_level, CASE WHEN sharpe > 1 THEN 'excellent' WHEN sharpe > 0.5 THEN 'good' WHEN sharpe > 0 THEN 'fair' ELSE 'poor' END AS sharpe_label,
  concat_ws('; ', CASE WHEN -mdd > 0.15 THEN 'smaller positions' END, CASE WHEN sharpe < 0.5 THEN 'review signals' END, CASE WHEN win_rate < 0.4 THEN 'raise accuracy' END) AS advice FROM m""")
def strategy_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy in one row against buy and hold, with levels of risk and Sharpe ratio and what to do about them."""
    s = F.col("strategy")
    m = curve(spark, sf_dir).agg(F.sum(s).alias("total"), F.avg(s).alias("mean"), F.avg((s > 1e-9).cast("double")).alias("win_rate"), (F.try_divide(F.avg(s), F.stddev_pop(s)) * F.sqrt(F.lit(52.0))).alias("sharpe"), F.min("fall").alias("mdd"), F.sum("hold").alias("held"))
    fall, sharpe = -F.col("mdd"), F.col("sharpe")
    return m.select(
        *[F.round(c, 6).alias(n) for c, n in (("total", "total"), ("mean", "mean"), ("win_rate", "win_rate"), ("sharpe", "sharpe"), ("mdd", "max_drawdown"), ("held", "buy_and_hold"))], F.round(F.col("total") - F.col("held"), 6).alias("excess"),
        F.when(fall > 0.2, "high").when(fall > 0.1, "medium").otherwise("low").alias("risk_level"), F.when(sharpe > 1, "excellent").when(sharpe > 0.5, "good").when(sharpe > 0, "fair").otherwise("poor").alias("sharpe_label"),
        F.concat_ws("; ", F.when(fall > 0.15, "smaller positions"), F.when(sharpe < 0.5, "review signals"), F.when(F.col("win_rate") < 0.4, "raise accuracy")).alias("advice"))
