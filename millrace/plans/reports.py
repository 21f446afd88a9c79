"""Score reports, alerts, operation statistics, weight search, and summaries of frames."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.carry import before, inside, quantiles, with_carry, with_days
from millrace.plans.frames import MONTHS, _frame, _frame_sql, regimes
from millrace.plans.registry import query
from millrace.plans.returns import FACTS, facts
from millrace.plans.scores import SCORES, _scored
from millrace.tables import ARTICLES, DAILY, articles, daily, load

# ---- reports of scores

COMPONENTS = {"text": 0.3, "image": 0.4, "market": 0.2, "meta": 0.1}


@query(f"""WITH {SCORES}, s AS (SELECT *, round(score, 9) AS s9, round(confidence, 9) AS c9 FROM scores), used AS (SELECT * FROM s WHERE c9 > 0.3)
SELECT asset, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(min(score), 6) AS least, round(max(score), 6) AS most, round(avg(confidence), 6) AS confidence,
  round(avg(CASE WHEN s9 > 0.1 THEN 1.0 ELSE 0 END), 6) AS bullish, round(avg(CASE WHEN s9 < -0.1 THEN 1.0 ELSE 0 END), 6) AS bearish, round(avg(CASE WHEN c9 > 0.7 THEN 1.0 ELSE 0 END), 6) AS sure,
  count(*) FILTER (s9 > 0.5) AS strong_bullish, count(*) FILTER (s9 > 0.1 AND s9 <= 0.5) AS moderate_bullish, count(*) FILTER (s9 BETWEEN -0.1 AND 0.1) AS neutral, count(*) FILTER (s9 >= -0.5 AND s9 < -0.1) AS moderate_bearish, count(*) FILTER (s9 < -0.5) AS strong_bearish,
  {', '.join(f'round(quantile_cont(score, {p / 100}), 6) AS p{p}' for p in (10, 25, 50, 75, 90))}, {', '.join(f'round(abs(avg({k})) * {w}, 6) AS {k}_contribution' for k, w in COMPONENTS.items())} FROM used GROUP BY 1""")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure scores of each asset: moments, shares, five bins, percentiles, and what each component adds."""
    s = _scored(spark, sf_dir).withColumns({"r": F.round("score", 9), "c": F.round("confidence", 9)}).where("c > 0.3")
    r, share = F.col("r"), lambda c: F.round(F.avg(c.cast("double")), 6)
    bins = {"strong_bullish": r > 0.5, "moderate_bullish": (r > 0.1) & (r <= 0.5), "neutral": r.between(-0.1, 0.1), "moderate_bearish": (r >= -0.5) & (r < -0.1), "strong_bearish": r < -0.5}
    at = quantiles(s, "event_type", "score", {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)}).withColumnRenamed("event_type", "asset")
    g = s.groupBy(F.col("event_type").alias("asset")).agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("sd"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"), F.round(F.avg("confidence"), 6).alias("confidence"),
        share(r > 0.1).alias("bullish"), share(r < -0.1).alias("bearish"), share(F.col("c") > 0.7).alias("sure"), *[F.count_if(c).alias(k) for k, c in bins.items()],
        *[F.round(F.abs(F.avg(k)) * w, 6).alias(f"{k}_contribution") for k, w in COMPONENTS.items()])
    return g.join(at, "asset").select(*g.columns, *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (10, 25, 50, 75, 90)])


@query(f"""WITH {SCORES}, last AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY asset ORDER BY ts DESC, event_id DESC) <= 100), l20 AS (SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY asset ORDER BY ts DESC, event_id DESC) <= 20),
live AS (SELECT asset, round(avg(score) FILTER (score <> 0), 6) AS live_mean, count(*) FILTER (score <> 0) AS live_n FROM l20 GROUP BY 1)
SELECT asset, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(avg(confidence), 6) AS confidence, {', '.join(f'round(avg({k}), 6) AS {k}_mean, CAST(round(min({k}), 6) AS DOUBLE) AS {k}_min, CAST(round(max({k}), 6) AS DOUBLE) AS {k}_max' for k in COMPONENTS)}, any_value(live_mean) AS live_mean, any_value(live_n) AS live_n FROM last JOIN live USING (asset) GROUP BY 1""")
def recent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred scores of each asset by component, and of the last twenty the mean of those that aren't zero."""
    w = W.partitionBy("asset").orderBy(F.desc("ts"), F.desc("event_id"))
    last = _scored(spark, sf_dir).withColumn("asset", F.col("event_type")).withColumn("i", F.row_number().over(w)).where("i <= 100")
    live = (F.col("i") <= 20) & (F.col("score") != 0)
    parts = [x for k in COMPONENTS for x in (F.round(F.avg(k), 6).alias(f"{k}_mean"), F.round(F.min(k), 6).alias(f"{k}_min"), F.round(F.max(k), 6).alias(f"{k}_max"))]
    return last.groupBy("asset").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("sd"), F.round(F.avg("confidence"), 6).alias("confidence"), *parts, F.round(F.avg(F.when(live, F.col("score"))), 6).alias("live_mean"), F.count_if(live).alias("live_n"))


@query(f"""WITH {SCORES}, r AS (SELECT user_id, asset, round(score, 9) AS s, round(confidence, 9) AS c FROM scores), best AS (SELECT user_id, asset, arg_max(s, (abs(s), s)) AS s, max(c) AS c FROM r GROUP BY 1, 2)
SELECT user_id, count(*) AS assets, arg_max(asset, (abs(s), asset)) AS dominant, round(max(abs(s)), 6) AS strongest, round(max(c), 6) AS surest, CASE WHEN max(abs(s)) >= 0.5 AND max(c) >= 0.8 THEN 'extreme' WHEN max(abs(s)) >= 0.3 THEN 'significant' ELSE 'info' END AS level FROM best GROUP BY 1""")
def alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per channel: its assets' strongest scores, which asset leads, and the alert's level."""
    s = F.col("s")
    r = _scored(spark, sf_dir).select("user_id", F.col("event_type").alias("asset"), F.round("score", 9).alias("s"), F.round("confidence", 9).alias("c"))
    best = r.groupBy("user_id", "asset").agg(F.max_by("s", F.struct(F.abs(s), s)).alias("s"), F.max("c").alias("c"))
    top, sure = F.max(F.abs(s)), F.max("c")
    return best.groupBy("user_id").agg(
        F.count("*").alias("assets"), F.max_by("asset", F.struct(F.abs(s), "asset")).alias("dominant"), F.round(top, 6).alias("strongest"), F.round(sure, 6).alias("surest"),
        F.when((top >= 0.5) & (sure >= 0.8), "extreme").when(top >= 0.3, "significant").otherwise("info").alias("level"))


@query("""WITH now_ AS (SELECT max(ts) AS now FROM events) SELECT event_id, CAST(round(CASE WHEN hour(ts) BETWEEN 9 AND 16 THEN 0.1 ELSE 0 END + CASE WHEN isodow(ts) < 6 THEN 0.05 ELSE 0 END + CASE WHEN epoch_us(now) - epoch_us(ts) < 4 * 3600000000 THEN 0.1 WHEN epoch_us(now) - epoch_us(ts) < 24 * 3600000000 THEN 0.05 ELSE 0 END, 6) AS DOUBLE) AS score, CASE WHEN ts IS NULL THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM events, now_""")
def market_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score from the hour, the weekday and how long before the last event an event came."""
    e = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").alias("now"))
    age = F.unix_micros("now") - F.unix_micros("ts")
    hour = 3_600_000_000
    score = F.when(F.hour("ts").between(9, 16), 0.1).otherwise(0.0) + F.when(F.weekday("ts") < 5, 0.05).otherwise(0.0) + F.when(age < 4 * hour, 0.1).when(age < 24 * hour, 0.05).otherwise(0.0)
    return e.crossJoin(F.broadcast(now)).select("event_id", F.round(score, 6).alias("score"), F.when(F.col("ts").isNull(), 0.0).otherwise(0.7).alias("confidence"))


# ---- operations

@query("""WITH last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100)
SELECT event_type AS operation, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, CASE WHEN count(*) >= 20 THEN list_sort(list(value))[CAST(floor(0.95 * count(*)) AS INTEGER) + 1] ELSE max(value) END AS p95 FROM last GROUP BY 1""")
def operation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred runs of each operation: duration's mean, ends and 95th percentile by index."""
    last = load(spark, sf_dir, "events").withColumn("i", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).where("i <= 100")
    n = F.count("*")
    p95 = F.when(n >= 20, F.get(F.sort_array(F.collect_list("value")), F.floor(0.95 * n).cast("int"))).otherwise(F.max("value"))
    return last.groupBy(F.col("event_type").alias("operation")).agg(n.alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), p95.alias("p95"))


@query("""SELECT count(*) AS operations, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error_rate, round(avg(value), 6) AS mean_value, max(value) AS peak,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 6) AS per_second, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_of_successful FROM events""")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations as one session: totals, rates, throughput and peak."""
    ok = F.col("event_type") != "error"
    us = lambda f: F.unix_micros(f(F.col("ts").cast("timestamp")))
    seconds = (us(F.max) - us(F.min)) / 1e6
    return load(spark, sf_dir, "events").agg(
        F.count("*").alias("operations"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.round(F.avg((~ok).cast("double")), 6).alias("error_rate"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("peak"),
        F.round(seconds, 3).alias("seconds"), F.round(F.try_divide(F.count("*"), seconds), 6).alias("per_second"), F.round(F.avg(F.when(ok, F.col("value"))), 6).alias("mean_of_successful"))


@query("""SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 3.7e-7, 4) AS running_mean FROM events""")
def running_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each user's values so far, after every event: by day, with sums and counts carried from the days before."""
    e = with_days(load(spark, sf_dir, "events").select(F.col("user_id").alias("asset"), "event_id", "ts", "value"))
    so_far = inside("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    carried = {k: F.coalesce(F.sum(c).over(before()), F.lit(0)) for k, c in (("sum_before", "_sum"), ("n_before", "_n"))}
    x = with_carry(e, [F.sum("value").alias("_sum"), F.count("value").alias("_n")], carried)
    mean = F.try_divide(F.col("sum_before") + F.coalesce(F.sum("value").over(so_far), F.lit(0.0)), F.col("n_before") + F.count("value").over(so_far))
    return x.select(F.col("asset").alias("user_id"), "event_id", F.round(mean + 3.7e-7, 4).alias("running_mean"))


# ---- search for weights and thresholds

GRID = [w for w in product((0.1, 0.2, 0.3, 0.4, 0.5), repeat=3) if sum(w) <= 0.95]
_GRID_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in GRID) + ") g(w1, w2, w3)"
_SEARCH = f"""{FACTS}, base AS (SELECT article_id, ret, signal - 0.5 AS x1, CASE bias WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END AS x2, confidence - 0.5 AS x3, confidence FROM facts WHERE days = 7 AND ret IS NOT NULL AND confidence >= 0.3), grid AS ({_GRID_SQL}),
evaluated AS (SELECT w1, w2, w3, sign(w1 * x1 + w2 * x2 + w3 * x3) * ret AS pnl, w1 * x1 + w2 * x2 + w3 * x3 AS s, ret FROM base, grid),
metrics AS (SELECT w1, w2, w3, count(*) AS n, avg(pnl) / nullif(stddev_pop(pnl), 0) AS ir, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS hit, corr(s, ret) AS r FROM evaluated GROUP BY ALL)"""


@query(f"""WITH {_SEARCH} SELECT round(w1 / (w1 + w2 + w3), 6) AS signal_weight, round(w2 / (w1 + w2 + w3), 6) AS bias_weight, round(w3 / (w1 + w2 + w3), 6) AS confidence_weight, n, round(ir, 6) AS information_ratio, round(hit, 6) AS hit_rate, round(r, 6) AS correlation, round(0.4 * ir + 0.3 * hit + 0.3 * abs(r), 6) AS combined FROM metrics""")
def weight_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate set of weights against all articles, in one grouping: information ratio, hit rate, correlation and their blend."""
    m = candidates(spark, sf_dir)
    total = F.col("w1") + F.col("w2") + F.col("w3")
    names = ("signal_weight", "bias_weight", "confidence_weight")
    shares = [F.round(F.col(f"w{i}") / total, 6).alias(n) for i, n in enumerate(names, 1)]
    return m.select(*shares, "n", F.round("ir", 6).alias("information_ratio"), F.round("hit", 6).alias("hit_rate"), F.round("r", 6).alias("correlation"), F.round("combined", 6).alias("combined"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w1, w2, w3, n, ir, hit, r, combined) of every set of weights in GRID."""
    f = facts(spark, sf_dir).where("days = 7 AND ret IS NOT NULL AND confidence >= 0.3")
    side = F.when(F.col("bias") == "bullish", 1.0).when(F.col("bias") == "bearish", -1.0).otherwise(0.0)
    base = f.select("ret", (F.col("signal") - 0.5).alias("x1"), side.alias("x2"), (F.col("confidence") - 0.5).alias("x3"))
    grid = spark.createDataFrame(GRID, "w1 double, w2 double, w3 double")
    s = sum((F.col(f"w{i}") * F.col(f"x{i}") for i in (1, 2, 3)), F.lit(0.0))
    e = base.crossJoin(F.broadcast(grid)).withColumn("s", s).withColumn("pnl", F.signum("s") * F.col("ret"))
    m = e.groupBy("w1", "w2", "w3").agg(F.count("*").alias("n"), F.try_divide(F.avg("pnl"), F.stddev_pop("pnl")).alias("ir"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit"), F.corr("s", "ret").alias("r"))
    return m.withColumn("combined", 0.4 * F.col("ir") + 0.3 * F.col("hit") + 0.3 * F.abs("r"))


@query(f"""WITH {_SEARCH}, c AS (SELECT *, 0.4 * ir + 0.3 * hit + 0.3 * abs(r) AS combined FROM metrics), b AS (SELECT ir AS ir0, hit AS hit0, combined AS c0 FROM c WHERE w1 = 0.3 AND w2 = 0.4 AND w3 = 0.2)
SELECT count(*) AS candidates, round(max(combined), 6) AS best, round(max(combined) - any_value(c0), 6) AS improvement, round(avg(combined - c0), 6) AS mean_improvement, count(*) FILTER (combined > c0) AS better, round(max(ir) - any_value(ir0), 6) AS ir_improvement, round(max(hit) - any_value(hit0), 6) AS hit_improvement FROM c, b""")
def optimization_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search gains over the weights 0.3, 0.4, 0.2: best and mean improvement, and how many candidates are better."""
    m = candidates(spark, sf_dir)
    base = m.where("w1 = 0.3D AND w2 = 0.4D AND w3 = 0.2D").select(F.col("ir").alias("ir0"), F.col("hit").alias("hit0"), F.col("combined").alias("c0"))
    gain = F.col("combined") - F.col("c0")
    return m.crossJoin(F.broadcast(base)).agg(
        F.count("*").alias("candidates"), F.round(F.max("combined"), 6).alias("best"), F.round(F.max(gain), 6).alias("improvement"), F.round(F.avg(gain), 6).alias("mean_improvement"), F.count_if(gain > 0).alias("better"),
        F.round(F.max(F.col("ir") - F.col("ir0")), 6).alias("ir_improvement"), F.round(F.max(F.col("hit") - F.col("hit0")), 6).alias("hit_improvement"))


# ---- frames

@query(f"""WITH {DAILY} SELECT date, {', '.join(f"max(close) FILTER (asset = '{a}') AS {n}_close, max(volume) FILTER (asset = '{a}') AS {n}_volume" for a, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("5-LOW", "low")))} FROM daily GROUP BY 1""")
def wide_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each date with the assets' prices side by side, null where an asset has none."""
    names = (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("5-LOW", "low"))
    of = lambda c, a: F.max(F.when(F.col("asset") == a, F.col(c)))
    return daily(spark, sf_dir).groupBy("date").agg(*[of(c, a).alias(f"{n}_{c}") for a, n in names for c in ("close", "volume")])


@query(f"""WITH {MONTHS}, arts AS (SELECT asset, last_day(date) AS period, count(*) AS n, avg(signal) AS signal FROM articles GROUP BY 1, 2), j AS (SELECT m.*, n, signal FROM months m JOIN arts USING (asset, period))
SELECT asset, count(*) AS months, round(avg(n), 6) AS mean_articles, arg_max(period, (n, period)) AS busiest, round(avg(ret), 6) AS mean_return, arg_max(period, ret) AS best_month, arg_min(period, ret) AS worst_month, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12.0), 6) AS sharpe,
  round(corr(n, vol), 6) AS count_vol_corr, round(corr(signal, vol), 6) AS signal_vol_corr, round(corr(n, ret), 6) AS count_ret_corr, round(avg(ret) + stddev_samp(ret), 6) AS upper, round(avg(ret) - stddev_samp(ret), 6) AS lower, round(regr_slope(ret, n), 8) AS slope, round(regr_intercept(ret, n), 6) AS intercept FROM j GROUP BY 1""")
def monthly_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's months with articles: activity, returns, Sharpe ratio, correlations, one-deviation lines, and the line through returns by activity."""
    arts = articles(spark, sf_dir).groupBy("asset", F.last_day("date").alias("period")).agg(F.count("*").alias("n"), F.avg("signal").alias("signal"))
    j = regimes(spark, sf_dir).join(arts, ["asset", "period"])
    mean, sd, r6 = F.avg("ret"), F.stddev_samp("ret"), lambda c: F.round(c, 6)
    return j.groupBy("asset").agg(
        F.count("*").alias("months"), r6(F.avg("n")).alias("mean_articles"), F.max_by("period", F.struct("n", "period")).alias("busiest"), r6(mean).alias("mean_return"), F.max_by("period", "ret").alias("best_month"), F.min_by("period", "ret").alias("worst_month"),
        r6(F.try_divide(mean, sd) * F.sqrt(F.lit(12.0))).alias("sharpe"), r6(F.corr("n", "vol")).alias("count_vol_corr"), r6(F.corr("signal", "vol")).alias("signal_vol_corr"), r6(F.corr("n", "ret")).alias("count_ret_corr"),
        r6(mean + sd).alias("upper"), r6(mean - sd).alias("lower"), F.round(F.regr_slope("ret", "n"), 8).alias("slope"), r6(F.regr_intercept("ret", "n")).alias("intercept"))


@query(f"""WITH {FACTS}, m AS (SELECT days, last_day(date) AS period, avg(ret) AS mean, stddev_samp(ret) AS sd FROM facts GROUP BY 1, 2) SELECT days, count(*) AS months, round(avg(mean), 6) AS mean_of_means, round(avg(sd), 6) AS mean_of_deviations FROM m GROUP BY 1""")
def mean_of_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = facts(spark, sf_dir).groupBy("days", F.last_day("date").alias("period")).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    return m.groupBy("days").agg(F.count("*").alias("months"), F.round(F.avg("mean"), 6).alias("mean_of_means"), F.round(F.avg("sd"), 6).alias("mean_of_deviations"))


@query(f"""WITH {DAILY} SELECT asset, last_day(date) AS period, round(arg_max(close, date) / nullif(arg_min(close, date), 0) - 1, 6) AS ret, count(*) AS days FROM daily GROUP BY 1, 2""")
def month_first_to_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's return from its first close to its last."""
    return daily(spark, sf_dir).groupBy("asset", F.last_day("date").alias("period")).agg(F.round(F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1, 6).alias("ret"), F.count("*").alias("days"))


@query(f"""WITH w AS ({_frame_sql("W")}) SELECT asset, period, n, ret, mean_vol FROM w WHERE period BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND n > 0""")
def period_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly frame between two dates, weeks with articles only."""
    return _frame(spark, sf_dir, "W").where("period BETWEEN DATE'1996-01-01' AND DATE'1997-12-31' AND n > 0").select("asset", "period", "n", "ret", "mean_vol")


@query(f"""WITH w AS ({_frame_sql("W")}) SELECT asset, count(*) AS weeks, round(corr(n, ret), 6) AS count_ret_corr, round(corr(n, mean_vol), 6) AS count_vol_corr, round(corr(mean_signal, ret), 6) AS signal_ret_corr FROM w GROUP BY 1""")
def weekly_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda a, b: F.round(F.corr(a, b), 6)
    return _frame(spark, sf_dir, "W").groupBy("asset").agg(F.count("*").alias("weeks"), r("n", "ret").alias("count_ret_corr"), r("n", "mean_vol").alias("count_vol_corr"), r("mean_signal", "ret").alias("signal_ret_corr"))


_FILTERED = "days = 14 AND asset IN ('1-URGENT', '2-HIGH') AND bias = 'bullish' AND date BETWEEN DATE '1995-06-01' AND DATE '1999-06-30' AND confidence BETWEEN 0.25 AND 0.95"


@query(f"WITH {FACTS} SELECT article_id, asset, date, round(ret, 6) AS ret FROM facts WHERE {_FILTERED}")
def fact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one horizon for some assets, one bias, a range of dates and of confidence."""
    return facts(spark, sf_dir).where(_FILTERED.replace("DATE '", "DATE'")).select("article_id", "asset", "date", F.round("ret", 6).alias("ret"))


@query(f"""WITH {ARTICLES}, as_of AS (SELECT max(date) AS d FROM articles), spans AS (SELECT unnest([7, 30, 90, 9999]) AS span)
SELECT span, count(*) AS n, round(avg(signal), 6) AS mean_signal, min(date) AS first_date, max(date) AS last_date FROM articles, as_of, spans WHERE date >= d - CAST(span AS INTEGER) GROUP BY 1""")
def lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the last 7, 30, 90 and 9999 days before the last one."""
    a = articles(spark, sf_dir)
    as_of = a.agg(F.max("date").alias("d"))
    spans = F.filter(F.array(*map(F.lit, (7, 30, 90, 9999))), lambda s: F.datediff("d", "date") <= s)
    x = a.crossJoin(F.broadcast(as_of)).withColumn("span", F.explode(spans))
    return x.groupBy("span").agg(F.count("*").alias("n"), F.round(F.avg("signal"), 6).alias("mean_signal"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("""WITH j AS (SELECT c.c_custkey, c.c_name, c.c_acctbal, n.n_name AS c_nation, s.s_suppkey, s.s_name, s.s_acctbal FROM customer c JOIN supplier s ON s.s_nationkey = c.c_nationkey AND s.s_suppkey % 25 = c.c_custkey % 25 JOIN nation n ON n.n_nationkey = c.c_nationkey)
SELECT c_nation AS nation, count(*) AS n, round(avg(c_acctbal) + 3.7e-7, 4) AS acctbal_customer, round(avg(s_acctbal) + 3.7e-7, 4) AS acctbal_supplier FROM j GROUP BY 1""")
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames with a column of one name, joined; each side's comes back with its suffix."""
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 25).alias("k"), F.col("c_acctbal").alias("acctbal"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 25).alias("k"), F.col("s_acctbal").alias("acctbal"))
    j = with_suffixes(c, s, ["nation", "k"], ("_customer", "_supplier"))
    g = j.groupBy("nation").agg(F.count("*").alias("n"), F.round(F.avg("acctbal_customer") + 3.7e-7, 4).alias("acctbal_customer"), F.round(F.avg("acctbal_supplier") + 3.7e-7, 4).alias("acctbal_supplier"))
    names = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return g.join(names, "nation").select(F.col("n_name").alias("nation"), "n", "acctbal_customer", "acctbal_supplier")


def with_suffixes(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """A join in which columns that both sides have, but for the keys, get a suffix."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    name = lambda df, s: df.select(*[F.col(c).alias(c + s if c in both else c) for c in df.columns])
    return name(left, suffixes[0]).join(name(right, suffixes[1]), on, how)


@query("""SELECT l_returnflag, l_linestatus, printf('%.1f%%', 100 * avg(l_discount)) AS discount, CASE WHEN sum(l_extendedprice) >= 1e9 THEN printf('$%.1fB', sum(l_extendedprice) / 1e9) WHEN sum(l_extendedprice) >= 1e6 THEN printf('$%.1fM', sum(l_extendedprice) / 1e6) WHEN sum(l_extendedprice) >= 1e3 THEN printf('$%.1fK', sum(l_extendedprice) / 1e3) ELSE printf('$%.2f', sum(l_extendedprice)) END AS revenue FROM lineitem GROUP BY 1, 2""")
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and amounts as people read them."""
    x = F.sum("l_extendedprice")
    money = F.when(x >= 1e9, F.format_string("$%.1fB", x / 1e9)).when(x >= 1e6, F.format_string("$%.1fM", x / 1e6)).when(x >= 1e3, F.format_string("$%.1fK", x / 1e3)).otherwise(F.format_string("$%.2f", x))
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.format_string("%.1f%%", 100 * F.avg("l_discount")).alias("discount"), money.alias("revenue"))
