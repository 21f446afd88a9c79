"""Prices joined to articles by time: the event-returns view, as-of lookups, windows ahead, and returns between events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.asof import ahead, last_before, micros, nearest
from millrace.plans.registry import query
from millrace.tables import ARTICLES, DAILY, TICKS, articles, daily, ticks

HOUR = 3_600_000_000
#: name, hours after publication, tolerance in hours.
HORIZONS = [("at_pub", 0, 1.0), ("4h", 4, 0.5), ("24h", 24, 1.0), ("72h", 72, 2.0), ("7d", 168, 4.0)]
DAYS_AHEAD = [1, 3, 7, 14, 30]
#: Keeps sums of cents off the halves that two engines round differently.
OFF_TIES = 3.7e-9


def horizon_points(events: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """Each event with enough confidence, five times: `at` is its publication or a horizon after it, tol the tolerance there."""
    horizons = events.sparkSession.createDataFrame([(n, h * HOUR, int(t * HOUR)) for n, h, t in HORIZONS], "name string, shift long, tol long")
    kept = events.where(F.col("confidence") >= least_confidence)
    return kept.crossJoin(F.broadcast(horizons)).withColumn("at", F.timestamp_micros(micros(F.col("ts")) + F.col("shift")))


def returns_of(found: DataFrame) -> DataFrame:
    """One row per event of (article_id, asset, ts, confidence, name, price), with log returns; those without a price at publication go."""
    wide = found.groupBy("article_id", "asset", "ts", "confidence").agg(*[F.max(F.when(F.col("name") == n, F.col("price"))).alias(f"price_{n}") for n, _, _ in HORIZONS])
    returns = [F.round(F.when((F.col("price_at_pub") > 0) & (F.col(f"price_{n}") > 0), F.log(F.col(f"price_{n}") / F.col("price_at_pub"))), 6).alias(f"ret_{n}") for n, _, _ in HORIZONS[1:]]
    return wide.where("price_at_pub IS NOT NULL").select("article_id", "asset", "confidence", *[f"price_{n}" for n, _, _ in HORIZONS], *returns)


def event_returns_of(events: DataFrame, prices: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """events (article_id, asset, ts, confidence) with the prices nearest to publication and to each horizon, and log returns.

    Events below least_confidence go, and so do those without a price at publication.
    """
    points = horizon_points(events, least_confidence)
    found = nearest(points, prices, "asset", "at", "ts", "price", ["article_id", "asset", "ts", "confidence", "name"], F.col("tol"), 4 * HOUR, "event_id")
    return returns_of(found)


#: The assets of _events(): prices of others are never near one.
QUOTED = ["view", "click"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset = F.when(F.col("user_id") % 2 == 0, "view").otherwise("click")
    return ticks(spark, sf_dir).where("asset = 'signup'").select(F.col("event_id").alias("article_id"), asset.alias("asset"), "ts", ((F.col("event_id") % 10) / 10.0).alias("confidence"))


EVENTS = "events_ AS (SELECT event_id AS article_id, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'click' END AS asset, ts, (event_id % 10) / 10.0 AS confidence FROM events WHERE event_type = 'signup')"


def _nearest_sql(name: str, hours: int, tol: float) -> str:
    at = f"(a.ts + INTERVAL {hours} HOUR)"
    span = f"INTERVAL {int(tol * 60)} MINUTE"
    return f"""(SELECT article_id, arg_min(p.price, (abs(epoch_us(p.ts) - epoch_us({at})), p.ts, p.event_id)) AS price_{name}
    FROM events_ a JOIN ticks p ON p.asset = a.asset AND p.ts BETWEEN {at} - {span} AND {at} + {span} GROUP BY 1) n_{name}"""


@query(
    f"WITH {TICKS}, {EVENTS} SELECT article_id, asset, confidence, {', '.join(f'price_{n}' for n, _, _ in HORIZONS)}, "
    + ", ".join(f"CASE WHEN price_at_pub > 0 AND price_{n} > 0 THEN round(ln(price_{n} / price_at_pub), 6) END AS ret_{n}" for n, _, _ in HORIZONS[1:])
    + " FROM events_ "
    + " ".join(f"LEFT JOIN {_nearest_sql(*h)} USING (article_id)" for h in HORIZONS)
    + " WHERE confidence >= 0.5 AND price_at_pub IS NOT NULL"
)
def event_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_returns_of(_events(spark, sf_dir), ticks(spark, sf_dir).where(F.col("asset").isin(QUOTED)))


@query(f"""WITH {DAILY}, wanted AS (SELECT row_number() OVER (ORDER BY asset, date) AS id, asset, date + INTERVAL 3 DAY AS at FROM daily),
near AS (SELECT w.id, arg_min(p.close, (abs(date_diff('day', CAST(w.at AS DATE), p.date)), p.date)) AS close FROM wanted w JOIN daily p ON p.asset = w.asset AND abs(date_diff('day', CAST(w.at AS DATE), p.date)) <= 7 GROUP BY 1)
SELECT w.asset, CAST(w.at AS DATE) AS at, close FROM wanted w LEFT JOIN near USING (id)""")
def price_nearest_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = daily(spark, sf_dir)
    return _nearest_7d(p, p)


def _nearest_7d(days: DataFrame, p: DataFrame) -> DataFrame:
    """The price three days on, else of the nearest day within seven; of two as near, the earlier."""
    wanted = days.select("asset", F.date_add("date", 3).alias("at"))
    return nearest(wanted, p, "asset", "at", "date", "close", ["asset", "at"], F.lit(7 * 24 * HOUR), 8 * 24 * HOUR).select("asset", "at", "close")


@query(f"""WITH {DAILY}, near AS (SELECT w.asset, w.date, arg_min(p.close, (abs(date_diff('day', w.date + 3, p.date)), p.date)) AS close
  FROM daily w JOIN daily p ON p.asset = w.asset AND p.date BETWEEN w.date - 4 AND w.date + 10 GROUP BY 1, 2)
SELECT w.asset, w.date + 3 AS at, near.close FROM daily w LEFT JOIN near USING (asset, date)""")
def price_nearest_7d_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = daily(spark, sf_dir)
    return _nearest_7d(p, p)


@query(f"""WITH {TICKS}, s AS (SELECT event_id AS id, 'view' AS asset, ts FROM events WHERE event_type = 'signup'),
v AS (SELECT asset, ts, arg_max(price, event_id) AS price FROM ticks WHERE asset = 'view' GROUP BY 1, 2)
SELECT s.id, s.asset, v.price FROM s ASOF LEFT JOIN v ON s.asset = v.asset AND s.ts >= v.ts""")
def backward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    left = t.where("asset = 'signup'").select(F.col("event_id").alias("id"), F.lit("view").alias("asset"), "ts")
    return last_before(left, t.where("asset = 'view'"), "asset", "ts", "ts", "price", "event_id").select("id", "asset", "price")


def with_returns(prices: DataFrame) -> DataFrame:
    before = F.lag("close").over(W.partitionBy("asset").orderBy("date"))
    return prices.withColumn("return_1d", F.try_divide(F.col("close"), before) - 1)


def forward_windows(arts: DataFrame, prices: DataFrame, days: list[int] = DAYS_AHEAD) -> DataFrame:
    """(article_id, theme, bias, signal, confidence, asset, date, days, ret, vol): first open to last close in [date, date + days].

    vol: the sample deviation of daily returns there, times sqrt(days).  Windows without prices give no row.
    The result depends on asset and date alone, so it is worked out once for each such pair and then joined to the articles.
    """
    spark = arts.sparkSession
    horizon = spark.createDataFrame([(d,) for d in days], "days int")
    points = arts.select("asset", "date").distinct().crossJoin(F.broadcast(horizon))
    row = ["asset", "date", "days"]
    found = ahead(points, with_returns(prices), "asset", "date", F.col("days"), max(days)).groupBy(*row)
    out = found.agg(F.min_by("p_open", "p_date").alias("first"), F.max_by("p_close", "p_date").alias("last"), F.stddev_samp("p_return_1d").alias("sd"))
    out = out.select(*row, (F.try_divide(F.col("last"), F.col("first")) - 1).alias("ret"), (F.col("sd") * F.sqrt(F.col("days").cast("double"))).alias("vol"))
    return arts.join(out, ["asset", "date"]).select(*arts.columns, "days", "ret", "vol")


FACTS = f"""{DAILY}, {ARTICLES},
returns AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS return_1d FROM daily),
horizons AS (SELECT unnest([1, 3, 7, 14, 30]) AS days),
sums AS (SELECT article_id, a.asset, a.date, theme, bias, signal, confidence, days, arg_min(open, p.date) AS first, arg_max(close, p.date) AS last, stddev_samp(return_1d) AS sd
  FROM articles a, horizons h, returns p WHERE p.asset = a.asset AND p.date BETWEEN a.date AND a.date + CAST(days AS INTEGER) GROUP BY ALL),
facts AS (SELECT *, last / nullif(first, 0) - 1 AS ret, sd * sqrt(CAST(days AS DOUBLE)) AS vol FROM sums)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward_windows(articles(spark, sf_dir), daily(spark, sf_dir))


@query(f"WITH {FACTS} SELECT article_id, asset, days, round(ret, 6) AS ret, round(vol, 6) AS vol FROM facts")
def forward_window_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("article_id", "asset", "days", F.round("ret", 6).alias("ret"), F.round("vol", 6).alias("vol"))


def inter_events(arts: DataFrame, prices: DataFrame) -> DataFrame:
    """Consecutive article days of an asset, at most 30 days apart, with the return from the first open to the last close between."""
    a = arts.groupBy("asset", "date").agg(F.min_by("theme", "article_id").alias("theme"), F.min_by("signal", "article_id").alias("signal"))
    after = W.partitionBy("asset").orderBy("date")
    pairs = a.withColumns({"next_date": F.lead("date").over(after), "next_theme": F.lead("theme").over(after), "next_signal": F.lead("signal").over(after)})
    pairs = pairs.withColumn("gap", F.datediff("next_date", "date")).where("gap BETWEEN 1 AND 30")
    row = pairs.columns
    found = ahead(pairs, prices, "asset", "date", F.col("gap"), 30).groupBy(*row)
    out = found.agg(F.min_by("p_open", "p_date").alias("first"), F.max_by("p_close", "p_date").alias("last"))
    return out.select(*row, F.when(F.abs("first") > 1e-9, F.col("last") / F.col("first") - 1).alias("ret"))


INTER = f"""{DAILY}, {ARTICLES},
one AS (SELECT asset, date, arg_min(theme, article_id) AS theme, arg_min(signal, article_id) AS signal FROM articles GROUP BY 1, 2),
pairs AS (SELECT *, lead(date) OVER w AS next_date, lead(theme) OVER w AS next_theme, lead(signal) OVER w AS next_signal FROM one WINDOW w AS (PARTITION BY asset ORDER BY date)),
spans AS (SELECT q.asset, q.date, theme, signal, next_date, next_theme, next_signal, date_diff('day', q.date, next_date) AS gap, arg_min(open, p.date) AS first, arg_max(close, p.date) AS last
  FROM pairs q JOIN daily p ON p.asset = q.asset AND p.date BETWEEN q.date AND next_date WHERE date_diff('day', q.date, next_date) BETWEEN 1 AND 30 GROUP BY ALL),
inter AS (SELECT *, last / nullif(first, 0) - 1 AS ret FROM spans)"""


#: Former name.
INTER_ALL = INTER


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inter_events(articles(spark, sf_dir), daily(spark, sf_dir))


def _changes(pairs: DataFrame) -> DataFrame:
    return pairs.select("asset", "date", "next_date", "gap", "theme", "next_theme", F.round(F.col("next_signal") - F.col("signal") + OFF_TIES, 6).alias("signal_change"), F.round("ret", 6).alias("ret"))


def _transitions(pairs: DataFrame) -> DataFrame:
    out = pairs.groupBy("theme", "next_theme").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"), F.round(F.max("ret"), 6).alias("max_ret"), F.round(F.min("ret"), 6).alias("min_ret"))
    return out.where("n >= 2")


@query(f"WITH {INTER} SELECT asset, date, next_date, CAST(gap AS INTEGER) AS gap, theme, next_theme, round(next_signal - signal + {OFF_TIES}, 6) AS signal_change, round(ret, 6) AS ret FROM inter")
def inter_event_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(_all(spark, sf_dir))


@query(f"WITH {INTER} SELECT asset, date, next_date, CAST(gap AS INTEGER) AS gap, theme, next_theme, round(next_signal - signal + {OFF_TIES}, 6) AS signal_change, round(ret, 6) AS ret FROM inter")
def inter_event_returns_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as inter_event_returns, under its former name."""
    return _changes(_all(spark, sf_dir))


@query(f"""WITH {DAILY}, {ARTICLES}, dates AS (SELECT date, count(*) AS n FROM articles GROUP BY 1), pairs AS (SELECT date, n, lead(date) OVER (ORDER BY date) AS next_date FROM dates),
spans AS (SELECT q.date, q.next_date, q.n, p.asset, arg_min(open, p.date) AS first, arg_max(close, p.date) AS last FROM pairs q JOIN daily p ON p.date BETWEEN q.date AND q.next_date WHERE date_diff('day', q.date, q.next_date) BETWEEN 1 AND 30 GROUP BY ALL)
SELECT date, next_date, n, asset, round(last / nullif(first, 0) - 1, 6) AS ret FROM spans""")
def article_to_article_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each day with articles to the next such day, at most 30 days on: the return of every asset between them."""
    dates = articles(spark, sf_dir).groupBy("date").agg(F.count("*").alias("n"))
    pairs = dates.withColumn("next_date", F.lead("date").over(W.orderBy("date")))  # one row for each calendar day: few
    pairs = pairs.withColumn("gap", F.datediff("next_date", "date")).where("gap BETWEEN 1 AND 30")
    p = daily(spark, sf_dir)
    points = pairs.crossJoin(p.select("asset").distinct())
    found = ahead(points, p, "asset", "date", F.col("gap"), 30).groupBy("date", "next_date", "n", "asset")
    out = found.agg(F.min_by("p_open", "p_date").alias("first"), F.max_by("p_close", "p_date").alias("last"))
    return out.select("date", "next_date", "n", "asset", F.round(F.try_divide("last", "first") - 1, 6).alias("ret"))


@query(f"WITH {INTER} SELECT theme, next_theme, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(max(ret), 6) AS max_ret, round(min(ret), 6) AS min_ret FROM inter GROUP BY 1, 2 HAVING count(*) >= 2")
def theme_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(_all(spark, sf_dir))


@query(f"WITH {INTER_ALL} SELECT theme, next_theme, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(max(ret), 6) AS max_ret, round(min(ret), 6) AS min_ret FROM inter GROUP BY 1, 2 HAVING count(*) >= 2")
def theme_transitions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(_all(spark, sf_dir))


@query(f"""WITH {TICKS}, d AS (SELECT asset, CAST(ts AS DATE) AS date, arg_max(price, (ts, event_id)) AS close, count(*) AS n FROM ticks GROUP BY 1, 2)
SELECT asset, date, round(close, 6) AS close, n FROM d""")
def daily_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tick of each asset and UTC day."""
    return ticks(spark, sf_dir).groupBy("asset", F.to_date("ts").alias("date")).agg(F.round(F.max_by("price", F.struct("ts", "event_id")), 6).alias("close"), F.count("*").alias("n"))


@query(f"WITH {TICKS} SELECT asset, arg_max(price, (ts, event_id)) AS price, max(ts) AS ts FROM ticks GROUP BY 1")
def current_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("asset").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"))


@query(f"""WITH {DAILY}, s AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily)
SELECT a.asset, s.date FROM s, (SELECT DISTINCT asset FROM daily) a EXCEPT SELECT asset, date FROM daily""")
def missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = daily(spark, sf_dir)
    ends = p.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = p.select("asset").distinct().crossJoin(F.broadcast(ends)).select("asset", F.explode(F.sequence("lo", "hi")).alias("date"))
    return days.join(p, ["asset", "date"], "left_anti")
