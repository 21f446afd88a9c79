"""Accuracy, attribution, risk, draw-downs, score buckets and the event study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.stats import correlation, score_bucket, t_p_value
from millrace.operators.carry import DAY, before, cuts, inside, quantiles, with_carry, with_days
from millrace.plans.registry import query
from millrace.plans.returns import FACTS, facts
from millrace.tables import ARTICLES, DAILY, TICKS, articles, ticks

HIT = "CASE WHEN bias = 'bullish' AND ret > 0 THEN 1 WHEN bias = 'bearish' AND ret < 0 THEN 1 WHEN bias = 'neutral' AND abs(ret) < 0.02 THEN 1 ELSE 0 END"


def hit() -> Column:
    """1 where the return went the way of the bias: up, down, or less than 2 %; unknown biases miss."""
    ret = F.col("ret")
    ok = ((F.col("bias") == "bullish") & (ret > 0)) | ((F.col("bias") == "bearish") & (ret < 0)) | ((F.col("bias") == "neutral") & (F.abs(ret) < 0.02))
    return F.when(ok, 1).otherwise(0)


@query(f"WITH {FACTS} SELECT days, bias, count(*) AS n, round(avg({HIT}), 6) AS accuracy FROM facts GROUP BY 1, 2 UNION ALL SELECT days, 'all', count(*), round(avg({HIT}), 6) FROM facts GROUP BY 1")
def signal_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directional accuracy by horizon, for each bias and for all."""
    f = facts(spark, sf_dir).groupBy("days", "bias").agg(F.count("*").alias("n"), F.sum(hit()).alias("hits"))
    every = f.groupBy("days").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).withColumn("bias", F.lit("all"))
    return f.unionByName(every).select("days", "bias", "n", F.round(F.col("hits") / F.col("n"), 6).alias("accuracy"))


QUARTERS = f"""{FACTS}, cuts AS (SELECT quantile_cont(signal, 0.25) AS a, quantile_cont(signal, 0.5) AS b, quantile_cont(signal, 0.75) AS c FROM facts WHERE days = 7),
labelled AS (SELECT facts.*, CASE WHEN signal <= a THEN 'low' WHEN signal <= b THEN 'mid_low' WHEN signal <= c THEN 'mid_high' ELSE 'high' END AS quartile FROM facts, cuts WHERE days = 7)"""


def quartiles(df: DataFrame, column: str = "signal") -> DataFrame:
    """df with `quartile`: right-closed bins at the interpolated quartiles."""
    at = cuts(df, column, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    x = F.col(column)
    label = F.when(x <= F.col("_q1"), "low").when(x <= F.col("_q2"), "mid_low").when(x <= F.col("_q3"), "mid_high").otherwise("high")
    return df.join(F.broadcast(at), F.lit(True), "left").withColumn("quartile", label).drop("_q1", "_q2", "_q3")


@query(f"""WITH {QUARTERS} SELECT CASE WHEN GROUPING(theme) = 0 THEN 'theme' WHEN GROUPING(bias) = 0 THEN 'bias' WHEN GROUPING(y) = 0 THEN 'period' ELSE 'quartile' END AS part,
  coalesce(theme, bias, y, quartile) AS value, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(stddev_samp(ret), 6) AS sd_ret
  FROM (SELECT *, CAST(year(date) AS VARCHAR) AS y FROM labelled) GROUP BY GROUPING SETS ((theme), (bias), (y), (quartile))""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day returns by theme, bias, period and signal quartile, in one pass of grouping sets."""
    f = quartiles(facts(spark, sf_dir).where("days = 7")).withColumn("period", F.year("date").cast("string"))
    keys = ["theme", "bias", "period", "quartile"]
    g = f.groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"), F.round(F.stddev_samp("ret"), 6).alias("sd_ret"))
    part = F.when(F.col("theme").isNotNull(), "theme").when(F.col("bias").isNotNull(), "bias").when(F.col("period").isNotNull(), "period").otherwise("quartile")
    return g.select(part.alias("part"), F.coalesce(*keys).alias("value"), "n", "mean_ret", "sd_ret")


@query(f"""WITH {FACTS}, g AS (SELECT theme, count(*) AS n, avg(ret) AS m, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe FROM facts WHERE days = 30 GROUP BY 1)
SELECT theme, n, round(m, 6) AS mean_ret, round(sharpe, 6) AS sharpe, theme = (SELECT arg_max(theme, m) FROM g) AS best, theme = (SELECT arg_min(theme, m) FROM g) AS worst FROM g""")
def theme_attribution_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = facts(spark, sf_dir).where("days = 30").groupBy("theme").agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"))
    ends = g.agg(F.max_by("theme", "m").alias("top"), F.min_by("theme", "m").alias("low"))
    return g.crossJoin(F.broadcast(ends)).select("theme", "n", F.round("m", 6).alias("mean_ret"), F.round("sharpe", 6).alias("sharpe"), (F.col("theme") == F.col("top")).alias("best"), (F.col("theme") == F.col("low")).alias("worst"))


@query(f"""WITH {FACTS}, s AS (SELECT avg({HIT}) AS accuracy, avg(signal) AS mean_signal, avg(confidence) AS mean_confidence, count(*) AS n FROM facts WHERE days = 7),
t AS (SELECT arg_max(theme, m) AS best FROM (SELECT theme, avg(ret) AS m FROM facts WHERE days = 7 GROUP BY 1))
SELECT n, round(accuracy, 6) AS accuracy, round(mean_signal, 6) AS mean_signal, round(mean_confidence, 6) AS mean_confidence, best AS best_theme FROM s, t""")
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = facts(spark, sf_dir).where("days = 7").groupBy("theme").agg(F.avg("ret").alias("m"), F.count("*").alias("n"), F.sum(hit()).alias("hits"), F.sum("signal").alias("s"), F.sum("confidence").alias("c"))
    n = F.sum("n")
    return g.agg(n.alias("n"), F.round(F.sum("hits") / n, 6).alias("accuracy"), F.round(F.sum("s") / n, 6).alias("mean_signal"), F.round(F.sum("c") / n, 6).alias("mean_confidence"), F.max_by("theme", "m").alias("best_theme"))


@query(f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER (ORDER BY ret DESC, article_id) AS up, row_number() OVER (ORDER BY ret, article_id) AS down FROM facts WHERE days = 7 AND ret IS NOT NULL)
SELECT CASE WHEN up <= 10 THEN 'top' ELSE 'bottom' END AS side, CAST(CASE WHEN up <= 10 THEN up ELSE down END AS INTEGER) AS rank, article_id, theme, bias, round(ret, 6) AS ret FROM r WHERE up <= 10 OR down <= 10""")
def top_bottom(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """The n best and worst articles by seven-day return."""
    f = facts(spark, sf_dir).where("days = 7 AND ret IS NOT NULL").select("article_id", "theme", "bias", "ret")
    out = []
    for side, key in (("top", F.desc("ret")), ("bottom", F.asc("ret"))):
        few = f.orderBy(key, "article_id").limit(n)
        out.append(few.withColumn("rank", F.row_number().over(W.orderBy(key, "article_id"))).withColumn("side", F.lit(side)))
    return out[0].unionByName(out[1]).select("side", "rank", "article_id", "theme", "bias", F.round("ret", 6).alias("ret"))


STEPS = f"{TICKS}, steps AS (SELECT asset, ts, event_id, CASE WHEN lag(price) OVER w IS NOT NULL THEN least(10, greatest(-0.99, ln(price / lag(price) OVER w) / 10)) END AS ret FROM ticks WINDOW w AS (PARTITION BY asset ORDER BY ts, event_id) QUALIFY ret IS NOT NULL)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ts, event_id, ret): a tenth of the log step between an asset's ticks, clipped to [-0.99, 10]."""
    t = with_carry(with_days(ticks(spark, sf_dir)), [F.max_by("price", F.struct("ts", "event_id")).alias("close")], {"carried": F.last("close").over(before())})
    last = F.coalesce(F.lag("price").over(inside("ts", "event_id")), F.col("carried"))
    ret = F.least(F.lit(10.0), F.greatest(F.lit(-0.99), F.log(F.col("price") / last) / 10))
    return t.withColumn("ret", F.when(last.isNotNull(), ret)).where("ret IS NOT NULL").select("asset", "day", "ts", "event_id", "ret")


@query(f"""WITH {STEPS} SELECT asset, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_pop(ret), 6) AS sd, round(avg(ret) / nullif(stddev_pop(ret), 0), 6) AS sharpe, round(max(ret), 6) AS best, round(min(ret), 6) AS worst,
  round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(ret) FILTER (ret > 0), 6) AS mean_win, round(avg(ret) FILTER (ret < 0), 6) AS mean_loss,
  round(sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0), 6) AS profit_factor FROM steps GROUP BY 1 HAVING count(*) >= 10""")
def risk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per asset with at least 10 returns; a profit factor without losses is null."""
    r = F.col("ret")
    up, down = F.when(r > 0, r), F.when(r < 0, r)
    g = steps(spark, sf_dir).groupBy("asset").agg(
        F.count("*").alias("n"), F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_pop(r), 6).alias("sd"), F.round(F.try_divide(F.avg(r), F.stddev_pop(r)), 6).alias("sharpe"),
        F.round(F.max(r), 6).alias("best"), F.round(F.min(r), 6).alias("worst"), F.round(F.avg((r > 0).cast("double")), 6).alias("win_rate"),
        F.round(F.avg(up), 6).alias("mean_win"), F.round(F.avg(down), 6).alias("mean_loss"), F.round(F.try_divide(F.sum(up), -F.sum(down)), 6).alias("profit_factor"),
    )
    return g.where("n >= 10")


ROWS = "(PARTITION BY asset ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {STEPS}, c AS (SELECT *, exp(sum(ln(1 + ret)) OVER {ROWS}) AS wealth, sum(ret) OVER {ROWS} AS total FROM steps),
p AS (SELECT *, greatest(1, max(wealth) OVER {ROWS}) AS top, max(total) OVER {ROWS} AS high FROM c)
SELECT asset, round(max((top - wealth) / top), 6) AS compound, round(min(total - high), 6) AS additive FROM p GROUP BY 1""")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest fall from a peak: of compounded wealth, as a positive fraction, and of the running sum, negative."""
    so_far = inside("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    r = steps(spark, sf_dir).withColumns({"growth": F.sum(F.log1p("ret")).over(so_far), "gain": F.sum("ret").over(so_far)})
    # Each day's sums and highest prefixes; days before give where a day starts and the peaks it has to beat.
    whole = [F.max_by(c, F.struct("ts", "event_id")).alias(f"{c}_of_day") for c in ("growth", "gain")] + [F.max(c).alias(f"{c}_top") for c in ("growth", "gain")]
    start = {c: F.coalesce(F.sum(f"{c}_of_day").over(before()), F.lit(0.0)) for c in ("growth", "gain")}
    days = r.groupBy(*DAY).agg(*whole).withColumns({f"{c}_start": x for c, x in start.items()})
    days = days.withColumns({f"{c}_peak": F.max(F.col(f"{c}_start") + F.col(f"{c}_top")).over(before()) for c in start})
    p = r.join(days.select(*DAY, *[f"{c}_{x}" for c in start for x in ("start", "peak")]), list(DAY))
    total = {c: F.col(f"{c}_start") + F.col(c) for c in start}
    high = {c: F.greatest(F.col(f"{c}_peak"), F.col(f"{c}_start") + F.max(c).over(so_far)) for c in start}
    p = p.select("asset", F.greatest(F.lit(0.0), high["growth"]).alias("top"), total["growth"].alias("log_wealth"), (total["gain"] - high["gain"]).alias("fall"))
    return p.groupBy("asset").agg(F.round(F.max(1 - F.exp(F.col("log_wealth") - F.col("top"))), 6).alias("compound"), F.round(F.min("fall"), 6).alias("additive"))


@query(f"""WITH {STEPS}, v AS (SELECT asset, quantile_cont(ret, 0.05) AS var95 FROM steps GROUP BY 1)
SELECT asset, round(var95, 6) AS var95, round(avg(ret) FILTER (ret <= var95), 6) AS cvar95, round(any_value(m.p75), 6) AS p75
FROM steps JOIN v USING (asset) JOIN (SELECT asset, quantile_cont(ret, 0.75) AS p75 FROM steps GROUP BY 1) m USING (asset) GROUP BY asset, var95""")
def var_cvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    v = quantiles(s, "asset", "ret", {"var95": 0.05, "p75": 0.75})
    return s.join(v, "asset").groupBy("asset", "var95", "p75").agg(F.avg(F.when(F.col("ret") <= F.col("var95"), F.col("ret"))).alias("c")).select("asset", F.round("var95", 6).alias("var95"), F.round("c", 6).alias("cvar95"), F.round("p75", 6).alias("p75"))


@query(f"""WITH {STEPS}, s AS (SELECT asset, ts, event_id, ret > 0 AS win, row_number() OVER (PARTITION BY asset ORDER BY ts, event_id) - row_number() OVER (PARTITION BY asset, ret > 0 ORDER BY ts, event_id) AS island FROM steps WHERE ret <> 0)
SELECT asset, max(n) FILTER (win) AS longest_win, max(n) FILTER (NOT win) AS longest_loss FROM (SELECT asset, win, island, count(*) AS n FROM s GROUP BY 1, 2, 3) GROUP BY 1""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest runs of gains and of losses; zeros neither extend nor break one."""
    at = ("ts", "event_id")
    s = steps(spark, sf_dir).where("ret <> 0").withColumn("win", F.col("ret") > 0)
    s = with_carry(s, [F.max_by("win", F.struct(*at)).alias("last_win")], {"carried": F.last("last_win").over(before())})
    starts = s.withColumn("starts", (~F.col("win").eqNullSafe(F.coalesce(F.lag("win").over(inside(*at)), F.col("carried")))).cast("int"))
    starts = with_carry(starts, [F.sum("starts").alias("of_day")], {"earlier": F.coalesce(F.sum("of_day").over(before()), F.lit(0))})
    island = F.col("earlier") + F.sum("starts").over(inside(*at).rowsBetween(W.unboundedPreceding, 0))
    n = starts.withColumn("island", island).groupBy("asset", "win", "island").agg(F.count("*").alias("n"))
    return n.groupBy("asset").agg(F.max(F.when(F.col("win"), F.col("n"))).alias("longest_win"), F.max(F.when(~F.col("win"), F.col("n"))).alias("longest_loss"))


@query(f"""WITH {STEPS}, d AS (SELECT asset, CAST(ts AS DATE) AS date, sum(ret) * 100 AS pnl FROM steps GROUP BY 1, 2),
s AS (SELECT asset, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY 1),
e AS (SELECT asset, date, 10000 + sum(coalesce(pnl, 0)) OVER (PARTITION BY asset ORDER BY date) AS equity FROM s LEFT JOIN d USING (asset, date))
SELECT asset, date, round(equity, 4) AS equity, round((equity / max(equity) OVER (PARTITION BY asset ORDER BY date) - 1) * 100, 6) AS drawdown_pct FROM e""")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand and the running profit of each day, days without trades too, and the fall from the peak."""
    d = steps(spark, sf_dir).groupBy("asset", F.to_date("ts").alias("date")).agg((F.sum("ret") * 100).alias("pnl"))
    s = d.groupBy("asset").agg(F.sequence(F.min("date"), F.max("date")).alias("s")).select("asset", F.explode("s").alias("date"))
    w = W.partitionBy("asset").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    e = s.join(d, ["asset", "date"], "left").withColumn("equity", 10000 + F.sum(F.coalesce("pnl", F.lit(0.0))).over(w))
    return e.select("asset", "date", F.round("equity", 4).alias("equity"), F.round((F.col("equity") / F.max("equity").over(w) - 1) * 100, 6).alias("drawdown_pct"))


SCORED = f"{FACTS}, scored AS (SELECT *, (signal - 0.5) * 1.2 AS score FROM facts)"
BUCKET = "CASE WHEN score > 0.4 THEN 'strong_bullish' WHEN score > 0.1 THEN 'bullish' WHEN score >= -0.1 THEN 'neutral' WHEN score >= -0.4 THEN 'bearish' WHEN score IS NOT NULL THEN 'strong_bearish' END"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).withColumn("score", (F.col("signal") - 0.5) * 1.2)


def bucket_statistics(events: DataFrame) -> DataFrame:
    """events (score, days, ret, confidence) by score bucket and horizon, with the t of mean 0 where there are 3 or more."""
    g = events.where("ret IS NOT NULL").groupBy(score_bucket(F.col("score")).alias("bucket"), "days").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.stddev_samp("ret").alias("s"))
    t = F.when(F.col("n") >= 3, F.try_divide(F.col("mean"), F.col("s") / F.sqrt(F.col("n"))))
    return g.withColumns({"t": t, "annualized": F.col("mean") * 365 / F.col("days")}).drop("s")


@query(f"""WITH {SCORED} SELECT {BUCKET} AS bucket, days, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(ret), 6) AS mean, round(stddev_pop(ret), 6) AS sd,
  round(CASE WHEN count(*) >= 3 THEN avg(ret) / nullif(stddev_samp(ret) / sqrt(count(*)), 0) END, 6) AS t, round(avg(ret) * 365 / days, 6) AS annualized FROM scored WHERE ret IS NOT NULL GROUP BY 1, 2""")
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bucket_statistics(scored(spark, sf_dir))
    return b.select("bucket", "days", "n", *[F.round(c, 6).alias(c) for c in ("confidence", "mean", "sd", "t", "annualized")])


@query(f"""WITH {SCORED} SELECT days, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN corr(score, ret) END, 6) AS r,
  round(avg(CASE WHEN sign(CASE WHEN score > 0.1 THEN 1 WHEN score < -0.1 THEN -1 ELSE 0 END) = CASE WHEN ret > 0.02 THEN 1 WHEN ret < -0.02 THEN -1 ELSE 0 END THEN 1.0 ELSE 0 END), 6) AS hit_rate,
  round(avg(ret) / nullif(stddev_pop(ret), 0), 6) AS information_ratio, round(avg(ret) * 365 / days, 6) AS annualized FROM scored WHERE ret IS NOT NULL GROUP BY 1""")
def horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of score and return, three-way hit rate and information ratio by horizon."""
    side = lambda c, k: F.when(c > k, 1).when(c < -k, -1).otherwise(0)
    g = scored(spark, sf_dir).where("ret IS NOT NULL").groupBy("days").agg(
        F.count("*").alias("n"), F.when(F.count("*") >= 5, correlation("score", "ret")).alias("r"),
        F.avg((side(F.col("score"), 0.1) == side(F.col("ret"), 0.02)).cast("double")).alias("hit_rate"),
        F.try_divide(F.avg("ret"), F.stddev_pop("ret")).alias("information_ratio"), F.avg("ret").alias("m"))
    return g.select("days", "n", F.round("r", 6).alias("r"), F.round("hit_rate", 6).alias("hit_rate"), F.round("information_ratio", 6).alias("information_ratio"), F.round(F.col("m") * 365 / F.col("days"), 6).alias("annualized"))


@query()
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket_stats with two-sided p-values; the p-value has no SQL form and is tested against tables."""
    b = bucket_statistics(scored(spark, sf_dir))
    p = t_p_value()(F.col("t"), (F.col("n") - 1).cast("double"))
    return b.withColumn("p", p).withColumn("significant", F.col("p") < 0.05)


@query(f"""WITH {FACTS}, w AS (SELECT bias, date_trunc('week', date)::DATE AS week, ret FROM facts WHERE days = 7),
m AS (SELECT bias, week, avg(ret) AS m FROM w WHERE ret IS NOT NULL GROUP BY 1, 2)
SELECT bias, week, round(m, 6) AS mean_ret, round(avg(m) OVER (PARTITION BY bias ORDER BY week ROWS 3 PRECEDING), 6) AS rolling_4w FROM m""")
def sentiment_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return by bias and week, Monday to Sunday, and its mean over the last four rows."""
    m = facts(spark, sf_dir).where("days = 7 AND ret IS NOT NULL").groupBy("bias", F.date_trunc("week", "date").cast("date").alias("week")).agg(F.avg("ret").alias("m"))
    w = W.partitionBy("bias").orderBy("week").rowsBetween(-3, 0)
    return m.select("bias", "week", F.round("m", 6).alias("mean_ret"), F.round(F.avg("m").over(w), 6).alias("rolling_4w"))


@query(f"""WITH {FACTS} SELECT bias, count(ret) AS n, round(avg(ret), 6) AS mean_ret, round(median(ret), 6) AS median_ret,
  round(avg(CASE WHEN bias = 'bullish' THEN CAST(ret > 0 AS INTEGER) WHEN bias = 'bearish' THEN CAST(ret < 0 AS INTEGER) END), 6) AS hit_rate FROM facts WHERE days = 7 GROUP BY 1""")
def sentiment_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, median and hit rate by sentiment; neutral has no hit rate."""
    r = F.col("ret")
    direction = F.when(F.col("bias") == "bullish", (r > 0).cast("int")).when(F.col("bias") == "bearish", (r < 0).cast("int"))
    return facts(spark, sf_dir).where("days = 7").groupBy("bias").agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"), F.round(F.median("ret"), 6).alias("median_ret"), F.round(F.avg(direction), 6).alias("hit_rate"))


@query(f"""WITH {FACTS}, b AS (SELECT ret, (SELECT min(ret) FROM facts WHERE days = 7) AS lo, (SELECT max(ret) FROM facts WHERE days = 7) AS hi FROM facts WHERE days = 7 AND ret IS NOT NULL)
SELECT CAST(least(19, floor((ret - lo) / nullif(hi - lo, 0) * 20)) AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1""")
def return_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day returns in 20 equal bins."""
    f = facts(spark, sf_dir).where("days = 7 AND ret IS NOT NULL").select("ret")
    ends = f.agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    bin_ = F.least(F.lit(19), F.floor(F.try_divide(F.col("ret") - F.col("lo"), F.col("hi") - F.col("lo")) * 20)).cast("int")
    return f.crossJoin(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS}, wide AS (SELECT article_id, signal, confidence, max(ret) FILTER (days = 7) AS ret, max(vol) FILTER (days = 7) AS vol FROM facts GROUP BY 1, 2, 3)
SELECT round(corr(signal, confidence), 6) AS signal_confidence, round(corr(signal, ret), 6) AS signal_ret, round(corr(signal, vol), 6) AS signal_vol, round(corr(confidence, ret), 6) AS confidence_ret, round(corr(confidence, vol), 6) AS confidence_vol, round(corr(ret, vol), 6) AS ret_vol FROM wide""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).where("days = 7")
    cols = ["signal", "confidence", "ret", "vol"]
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i + 1 :]]
    return f.agg(*[F.round(correlation(x, y) if "vol" not in (x, y) else F.corr(x, y), 6).alias(f"{x}_{y}") for x, y in pairs])


@query(f"""WITH {ARTICLES}, c AS (SELECT signal, confidence, t / 10.0 AS threshold, CASE WHEN bias = 'bullish' THEN 1 WHEN bias = 'bearish' THEN -1 ELSE 0 END AS side FROM articles, range(1, 10) r(t))
SELECT threshold, count(*) AS kept, round(avg(side * (signal - 0.5)), 6) AS mean_gain, round(avg(side * (signal - 0.5)) / nullif(stddev_pop(side * (signal - 0.5)), 0), 6) AS information_ratio FROM c WHERE confidence >= threshold GROUP BY 1""")
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate confidence threshold, judged over all articles in one aggregation."""
    side = F.when(F.col("bias") == "bullish", 1).when(F.col("bias") == "bearish", -1).otherwise(0)
    gain = side * (F.col("signal") - 0.5)
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda t: t / 10)).alias("threshold")
    c = articles(spark, sf_dir).select("confidence", gain.alias("gain"), grid).where("confidence >= threshold")
    return c.groupBy("threshold").agg(F.count("*").alias("kept"), F.round(F.avg("gain"), 6).alias("mean_gain"), F.round(F.try_divide(F.avg("gain"), F.stddev_pop("gain")), 6).alias("information_ratio"))


@query(f"""WITH {ARTICLES}, {DAILY} SELECT (SELECT count(*) FROM articles) AS n_articles, (SELECT count(DISTINCT theme) FROM articles) AS themes, (SELECT count(DISTINCT asset) FROM daily) AS assets,
  least((SELECT min(date) FROM articles), (SELECT min(date) FROM daily)) AS first_date, greatest((SELECT max(date) FROM articles), (SELECT max(date) FROM daily)) AS last_date,
  (SELECT count(*) FROM articles WHERE confidence >= 0.8 AND theme IN ('theme1', 'theme2') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AS filtered""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and date range of both tables, and of the default filters."""
    from millrace.tables import daily

    a, d = articles(spark, sf_dir), daily(spark, sf_dir)
    kept = (F.col("confidence") >= 0.8) & F.col("theme").isin("theme1", "theme2") & F.col("date").between(F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    x = a.agg(F.count("*").alias("n_articles"), F.countDistinct("theme").alias("themes"), F.min("date").alias("a0"), F.max("date").alias("a1"), F.count_if(kept).alias("filtered"))
    y = d.agg(F.countDistinct("asset").alias("assets"), F.min("date").alias("d0"), F.max("date").alias("d1"))
    return x.crossJoin(y).select("n_articles", "themes", "assets", F.least("a0", "d0").alias("first_date"), F.greatest("a1", "d1").alias("last_date"), "filtered")
