"""Weekly and monthly frames, indicators, seasonality and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.rolling import full, indicators
from millrace.operators.calendar import ohlcv, period_end, spine
from millrace.plans.registry import query
from millrace.plans.returns import with_returns
from millrace.tables import ARTICLES, DAILY, articles, daily

VOL = "stddev_samp(return_1d) OVER (PARTITION BY asset ORDER BY date ROWS 6 PRECEDING)"
FRAME = f"""{DAILY}, {ARTICLES},
returns AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS return_1d FROM daily),
priced AS (SELECT *, CASE WHEN count(return_1d) OVER (PARTITION BY asset ORDER BY date ROWS 6 PRECEDING) = 7 THEN {VOL} END AS volatility FROM returns)"""
ENDS = {"W": "CAST(date + INTERVAL 1 DAY * ((7 - isodow(date)) % 7) AS DATE)", "M": "last_day(date)"}


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_returns(daily(spark, sf_dir))
    return p.withColumn("volatility", full(7, F.col("return_1d"), F.stddev_samp))


ZEROED = ["n", "mean_signal", "mean_confidence", "bullish", "bearish", "open", "high", "low", "close", "volume", "ret", "mean_vol"]


def _frame(spark: SparkSession, sf_dir: str, freq: str) -> DataFrame:
    """A row for each asset and period, periods without articles or prices too: what was written, and the asset's bar."""
    a = articles(spark, sf_dir)
    arts = a.groupBy(period_end(F.col("date"), freq).alias("period")).agg(
        F.count("*").alias("n"), F.round(F.avg("signal"), 6).alias("mean_signal"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.sum((F.col("bias") == "bullish").cast("long")).alias("bullish"), F.sum((F.col("bias") == "bearish").cast("long")).alias("bearish"),
    )
    priced = _priced(spark, sf_dir)
    bars = ohlcv(priced, freq).withColumns({"ret": F.round("ret", 6), "mean_vol": F.round("mean_vol", 6)})
    frame = spine(a, "date", freq).crossJoin(priced.select("asset").distinct())
    return frame.join(arts, "period", "left").join(bars, ["asset", "period"], "left").na.fill(0, ZEROED)


def _frame_sql(freq: str) -> str:
    end = ENDS[freq]
    step = "INTERVAL 7 DAY" if freq == "W" else "INTERVAL 1 MONTH"
    days = f"SELECT CAST(unnest(generate_series(min({end}), max({end}), {step})) AS DATE) AS period FROM articles"
    if freq == "M":
        days = "SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(date)), max(date), INTERVAL 1 MONTH)) AS DATE)) AS period FROM articles"
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ZEROED)
    return f"""WITH {FRAME}, spine AS ({days}), assets AS (SELECT DISTINCT asset FROM daily),
arts AS (SELECT {end} AS period, count(*) AS n, round(avg(signal), 6) AS mean_signal, round(avg(confidence), 6) AS mean_confidence,
  count(*) FILTER (bias = 'bullish') AS bullish, count(*) FILTER (bias = 'bearish') AS bearish FROM articles GROUP BY 1),
bars AS (SELECT asset, {end} AS period, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume,
  round(product(1 + return_1d) - 1, 6) AS ret, round(avg(volatility), 6) AS mean_vol FROM priced GROUP BY 1, 2)
SELECT asset, period, {zero} FROM spine CROSS JOIN assets LEFT JOIN arts USING (period) LEFT JOIN bars USING (asset, period)"""


@query(_frame_sql("W"))
def weekly_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "W")


@query(_frame_sql("M"))
def monthly_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "M")


FLOATS = ["mid_price", "price_range", "price_range_pct", "return_1d", "return_1d_bps", "log_return_1d", "return_overnight", "return_intraday", "volatility_7d", "volatility_14d", "volatility_30d", "sma_7", "sma_14", "sma_30", "price_vs_sma_7", "price_vs_sma_14", "price_vs_sma_30", "price_percentile_30d", "price_percentile_60d", "price_percentile_90d", "implied_move_1d", "support_level", "resistance_level", "distance_to_support", "distance_to_resistance", "gap_size", "gap_size_pct", "volume_ratio", "dollar_volume", "vwap_approx", "upper_wick", "lower_wick", "body_size", "body_size_pct"]
#: Sums of cents over small counts often end in a 5 that rounding could turn either way; both engines shift them alike.
OFF_TIES = 3.7e-7
#: Fewer where values are so large that four digits are beyond a double's precision.
DIGITS = {"implied_move_1d": 1}
FLAGS = ["is_gap_up", "is_gap_down", "is_local_high", "is_local_low"]


def _indicators(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    out = indicators(daily(spark, sf_dir), variant)
    return out.select("asset", "date", *[F.round(F.col(c) + OFF_TIES, DIGITS.get(c, 4)).alias(c) for c in FLOATS], *FLAGS)


def _indicators_sql(variant: str) -> str:
    def full_(n: int, x: str, f: str) -> str:
        return f"CASE WHEN count({x}) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN {f} OVER (w ROWS {n - 1} PRECEDING) END"

    a = variant == "a"
    width = 14 if a else 20
    cols = [f"{full_(n, 'return_1d', 'stddev_samp(return_1d)')} * sqrt(365.0) * 100 AS volatility_{n}d" for n in (7, 14, 30)]
    cols += [f"{full_(n, 'close', 'avg(close)')} AS sma_{n}" for n in (7, 14, 30)]
    for n in (30, 60, 90):
        rows = f"list(close) OVER (w ROWS {n - 1} PRECEDING)"
        cols.append(f"CASE WHEN count(close) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN (len(list_filter({rows}, lambda y: y < close)) + (len(list_filter({rows}, lambda y: y = close)) + 1) / 2.0) / {n} * 100 END AS price_percentile_{n}d")
    cols += [f"{full_(width, 'low', 'min(low)')} AS support_level", f"{full_(width, 'high', 'max(high)')} AS resistance_level"]
    cols.append(f"volume / ({full_(20 if a else 30, 'volume', 'avg(volume)')}) AS volume_ratio")
    if a:
        cols.append(f"({full_(20, 'volume', 'sum(volume * close)')}) / ({full_(20, 'volume', 'sum(volume)')}) AS vwap_approx")
        cols += ["gap_size > 0 AS is_gap_up", "gap_size < 0 AS is_gap_down", "high > lag(high) OVER (w) AND high > lead(high) OVER (w) AS is_local_high", "low < lag(low) OVER (w) AND low < lead(low) OVER (w) AS is_local_low"]
    else:
        cols += ["(high + low + close) / 3 AS vwap_approx", "gap_size_pct > 1 AS is_gap_up", "gap_size_pct < -1 AS is_gap_down"]
        cols += [f"{x} = {f}({x}) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS {name}" for x, f, name in (("high", "max", "is_local_high"), ("low", "min", "is_local_low"))]
    move = "volatility_30d / sqrt(365.0)" + ("" if a else " * close")
    final = [f"round({c} + {OFF_TIES}, {DIGITS.get(c, 4)}) AS {c}" for c in FLOATS]
    return f"""WITH {DAILY}, prev AS (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY date) AS before FROM daily),
base AS (SELECT *, (high + low) / 2 AS mid_price, high - low AS price_range, (high - low) / nullif(close, 0) * 100 AS price_range_pct, close / nullif(before, 0) - 1 AS return_1d,
  (close / nullif(before, 0) - 1) * 10000 AS return_1d_bps, CASE WHEN close > 0 AND before > 0 THEN ln(close / before) END AS log_return_1d,
  open / nullif(before, 0) - 1 AS return_overnight, close / nullif(open, 0) - 1 AS return_intraday, open - before AS gap_size, (open - before) / nullif(before, 0) * 100 AS gap_size_pct,
  volume * close AS dollar_volume, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, abs(close - open) AS body_size, abs(close - open) / nullif(close, 0) * 100 AS body_size_pct FROM prev),
rolled AS (SELECT *, {', '.join(cols)} FROM base WINDOW w AS (PARTITION BY asset ORDER BY date)),
derived AS (SELECT *, {move} AS implied_move_1d, (close - support_level) / nullif(close, 0) * 100 AS distance_to_support, (resistance_level - close) / nullif(close, 0) * 100 AS distance_to_resistance,
  {', '.join(f'(close / nullif(sma_{n}, 0) - 1) * 100 AS price_vs_sma_{n}' for n in (7, 14, 30))} FROM rolled)
SELECT asset, date, {', '.join(final)}, {', '.join(FLAGS)} FROM derived"""


@query(_indicators_sql("a"))
def indicators_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indicators(spark, sf_dir, "a")


@query(_indicators_sql("b"))
def indicators_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indicators(spark, sf_dir, "b")


MONTHS = f"""{FRAME}, months AS (SELECT asset, last_day(date) AS period, product(1 + return_1d) - 1 AS ret, avg(volatility) AS vol FROM priced GROUP BY 1, 2),
edges AS (SELECT asset, quantile_cont(vol, 0.33) AS lo, quantile_cont(vol, 0.67) AS hi FROM months GROUP BY 1),
regimes AS (SELECT asset, period, ret, vol, CASE WHEN ret <= -0.05 THEN 'bear' WHEN ret <= 0.05 THEN 'sideways' WHEN ret > 0.05 THEN 'bull' END AS return_regime,
  CASE WHEN vol <= lo THEN 'low' WHEN vol <= hi THEN 'medium' WHEN vol > hi THEN 'high' END AS vol_regime FROM months JOIN edges USING (asset))"""


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's months with their return regime, at -5 and 5 %, and volatility tercile; right ends belong to the lower bin."""
    m = ohlcv(_priced(spark, sf_dir), "M").select("asset", "period", "ret", F.col("mean_vol").alias("vol"))
    edges = m.groupBy("asset").agg(F.percentile("vol", F.lit(0.33)).alias("lo"), F.percentile("vol", F.lit(0.67)).alias("hi"))
    r, v = F.col("ret"), F.col("vol")
    return m.join(edges, "asset").select(
        "asset", "period", "ret", "vol",
        F.when(r <= -0.05, "bear").when(r <= 0.05, "sideways").when(r > 0.05, "bull").alias("return_regime"),
        F.when(v <= F.col("lo"), "low").when(v <= F.col("hi"), "medium").when(v > F.col("hi"), "high").alias("vol_regime"),
    )


@query(f"WITH {MONTHS} SELECT asset, period, round(ret, 6) AS ret, round(vol, 6) AS vol, return_regime, vol_regime FROM regimes")
def market_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes(spark, sf_dir).select("asset", "period", F.round("ret", 6).alias("ret"), F.round("vol", 6).alias("vol"), "return_regime", "vol_regime")


@query(f"""WITH {MONTHS}, j AS (SELECT return_regime, theme FROM articles a JOIN regimes r ON r.asset = a.asset AND r.period = last_day(a.date))
SELECT return_regime, theme, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY return_regime), 6) AS percent FROM j GROUP BY 1, 2""")
def regime_theme_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of articles by the return regime of their asset's month."""
    j = articles(spark, sf_dir).withColumn("period", F.last_day("date")).join(regimes(spark, sf_dir), ["asset", "period"])
    n = j.groupBy("return_regime", "theme").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("return_regime")), 6))


@query(f"""WITH {MONTHS}, per AS (SELECT asset, last_day(date) AS period, count(*) AS n, avg(signal) AS signal FROM articles GROUP BY 1, 2)
SELECT return_regime, vol_regime, count(*) AS months, round(avg(n), 6) AS mean_articles, round(avg(signal), 6) AS mean_signal FROM regimes LEFT JOIN per USING (asset, period) GROUP BY 1, 2""")
def regime_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = articles(spark, sf_dir).groupBy("asset", F.last_day("date").alias("period")).agg(F.count("*").alias("n"), F.avg("signal").alias("signal"))
    return regimes(spark, sf_dir).join(per, ["asset", "period"], "left").groupBy("return_regime", "vol_regime").agg(F.count("*").alias("months"), F.round(F.avg("n"), 6).alias("mean_articles"), F.round(F.avg("signal"), 6).alias("mean_signal"))


@query(f"""WITH {ARTICLES} SELECT CAST(year(date) AS INTEGER) AS year, {', '.join(f'count(*) FILTER (month(date) = {m}) AS m{m:02d}' for m in range(1, 13))} FROM articles GROUP BY 1""")
def activity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir).withColumns({"year": F.year("date"), "month": F.month("date")})
    p = a.groupBy("year").pivot("month", list(range(1, 13))).count().na.fill(0)
    return p.select("year", *[F.col(f"`{m}`").alias(f"m{m:02d}") for m in range(1, 13)])


@query(f"""WITH {ARTICLES} SELECT CASE WHEN GROUPING(m) = 0 THEN 'month' WHEN GROUPING(q) = 0 THEN 'quarter' ELSE 'weekday' END AS part, coalesce(m, q, d) AS value,
  count(*) AS n, round(avg(signal), 6) AS mean_signal, round(stddev_samp(signal), 6) AS sd_signal
  FROM (SELECT signal, CAST(month(date) AS INTEGER) AS m, CAST(quarter(date) AS INTEGER) AS q, CAST(isodow(date) AS INTEGER) AS d FROM articles) GROUP BY GROUPING SETS ((m), (q), (d))""")
def seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal by month, quarter and weekday (Monday is 1), in one pass."""
    a = articles(spark, sf_dir).select("signal", F.month("date").alias("m"), F.quarter("date").alias("q"), (F.weekday("date") + 1).alias("d"))
    g = a.groupingSets([["m"], ["q"], ["d"]], "m", "q", "d").agg(F.count("*").alias("n"), F.round(F.avg("signal"), 6).alias("mean_signal"), F.round(F.stddev_samp("signal"), 6).alias("sd_signal"))
    part = F.when(F.col("m").isNotNull(), "month").when(F.col("q").isNotNull(), "quarter").otherwise("weekday")
    return g.select(part.alias("part"), F.coalesce("m", "q", "d").alias("value"), "n", "mean_signal", "sd_signal")


@query(f"""WITH {ARTICLES} SELECT CAST(month(date) AS INTEGER) AS month, {', '.join(f'round(avg(signal) FILTER (year(date) = {y}), 6) AS y{y}' for y in range(1995, 2002))} FROM articles GROUP BY 1""")
def yoy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir).withColumns({"year": F.year("date"), "month": F.month("date")})
    p = a.groupBy("month").pivot("year", list(range(1995, 2002))).agg(F.round(F.avg("signal"), 6))
    return p.select("month", *[F.col(f"`{y}`").alias(f"y{y}") for y in range(1995, 2002)])


@query(f"""WITH {MONTHS}, n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY period) - 1 AS i FROM months)
SELECT asset, count(*) AS n, round(regr_slope(ret, i), 6) AS ret_slope, round(regr_slope(vol, i), 6) AS vol_slope, round(regr_intercept(ret, i), 6) AS ret_intercept, round(corr(ret, vol), 6) AS ret_vol_corr FROM n GROUP BY 1""")
def trend_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = regimes(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("asset").orderBy("period")) - 1)
    return m.groupBy("asset").agg(F.count("*").alias("n"), F.round(F.regr_slope("ret", "i"), 6).alias("ret_slope"), F.round(F.regr_slope("vol", "i"), 6).alias("vol_slope"), F.round(F.regr_intercept("ret", "i"), 6).alias("ret_intercept"), F.round(F.corr("ret", "vol"), 6).alias("ret_vol_corr"))


@query(f"""WITH {MONTHS}, {', '.join(f"r{k} AS (SELECT asset, period, CASE WHEN count(ret) OVER (w ROWS {k - 1} PRECEDING) = {k} THEN avg(ret) OVER (w ROWS {k - 1} PRECEDING) END AS m, CASE WHEN count(ret) OVER (w ROWS {k - 1} PRECEDING) = {k} THEN stddev_samp(ret) OVER (w ROWS {k - 1} PRECEDING) END AS s FROM months WINDOW w AS (PARTITION BY asset ORDER BY period))" for k in (3, 6, 12))}
SELECT r3.asset, r3.period, {', '.join(f'round(r{k}.m, 6) AS mean_{k}, round(r{k}.m - r{k}.s, 6) AS low_{k}, round(r{k}.m + r{k}.s, 6) AS high_{k}, round(greatest(0, 1 - r{k}.s / nullif(abs(r{k}.m), 0)), 6) AS stability_{k}' for k in (3, 6, 12))}
FROM r3 JOIN r6 USING (asset, period) JOIN r12 USING (asset, period)""")
def rolling_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling mean, one-deviation bands and stability of each asset's monthly returns over 3, 6 and 12 months."""
    m = regimes(spark, sf_dir).select("asset", "period", "ret")
    order = W.partitionBy("asset").orderBy("period")
    cols = []
    for k in (3, 6, 12):
        w = order.rowsBetween(-(k - 1), 0)
        whole = F.count("ret").over(w) == k
        mean, sd = F.when(whole, F.avg("ret").over(w)), F.when(whole, F.stddev_samp("ret").over(w))
        cols += [F.round(mean, 6).alias(f"mean_{k}"), F.round(mean - sd, 6).alias(f"low_{k}"), F.round(mean + sd, 6).alias(f"high_{k}"), F.round(F.greatest(F.lit(0.0), 1 - F.try_divide(sd, F.abs(mean))), 6).alias(f"stability_{k}")]
    return m.select("asset", "period", *cols)
