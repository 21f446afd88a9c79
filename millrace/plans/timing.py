"""Prices at a time by the rule of the same day, realized returns with a known end, extended contexts, and features of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rolling import indicators, last
from millrace.operators.asof import last_before, micros, nearest
from millrace.plans.registry import ORACLES, query
from millrace.plans.returns import HOUR, _events, event_returns
from millrace.tables import DAILY, TICKS, daily, load, ticks

DAY_US = 24 * HOUR
HORIZONS = [24, 72, 168]


def price_at(points: DataFrame, prices: DataFrame, row: list[str], tolerance_us: int = HOUR) -> DataFrame:
    """points (row columns, asset, at) with `price`: the nearest of the same day, if there is one that day, else the nearest; null beyond the tolerance.

    A day that has prices decides alone: a nearer one of the day before doesn't count then.
    """
    day = lambda ts: F.floor(micros(F.col(ts)) / DAY_US)
    days = prices.select(F.col("asset").alias("_asset"), day("ts").alias("_day")).where("_day IS NOT NULL").distinct()
    left = points.join(days, (F.col("asset") == F.col("_asset")) & (day("at") == F.col("_day")), "left")
    # Where the day has prices, neighbours of other days don't count; null ends are no ends.
    within = (F.col("_day") * DAY_US, (F.col("_day") + 1) * DAY_US - 1)
    return nearest(left, prices, "asset", "at", "ts", "price", [*row, "asset", "at"], F.lit(tolerance_us), 4 * HOUR, "event_id", within)


_ORDER = "(abs(epoch_us(p.ts) - epoch_us(q.at)), p.ts, p.event_id)"
_PRICE = f"""own AS (SELECT id, k, arg_min(struct_pack(t := epoch_us(p.ts), p := p.price), {_ORDER}) AS h FROM points q JOIN ticks p ON p.asset = q.asset AND date_trunc('day', p.ts) = date_trunc('day', q.at) GROUP BY ALL),
other AS (SELECT id, k, arg_min(p.price, {_ORDER}) AS p FROM points q JOIN ticks p ON p.asset = q.asset AND p.ts BETWEEN q.at - INTERVAL 1 HOUR AND q.at + INTERVAL 1 HOUR GROUP BY ALL),
priced AS (SELECT q.id, q.k, q.asset, q.at, CASE WHEN own.h IS NULL THEN other.p WHEN abs(own.h.t - epoch_us(q.at)) <= {HOUR} THEN own.h.p END AS price FROM points q LEFT JOIN own USING (id, k) LEFT JOIN other USING (id, k))"""


@query(f"WITH {TICKS}, points AS (SELECT event_id AS id, 0 AS k, 'purchase' AS asset, ts AS at FROM events WHERE event_type = 'signup'), {_PRICE} SELECT id, price FROM priced")
def timed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every sign-up the purchase price at its time."""
    t = ticks(spark, sf_dir)
    points = t.where("asset = 'signup'").select(F.col("event_id").alias("id"), F.lit("purchase").alias("asset"), F.col("ts").cast("timestamp").alias("at"))
    return price_at(points, t.where("asset = 'purchase'"), ["id"]).select("id", "price")


@query(f"""WITH {TICKS}, now_ AS (SELECT max(ts) AS now_at FROM ticks), points AS (SELECT event_id AS id, h AS k, 'view' AS asset, least(ts + INTERVAL 1 DAY * (event_id % 5), now_at) + INTERVAL 1 HOUR * h AS at FROM events, now_, (SELECT unnest([0, 24, 72, 168]) AS h) WHERE event_type = 'signup'), {_PRICE},
wide AS (SELECT id, {', '.join(f'max(price) FILTER (k = {h}) AS p{h}' for h in (0, *HORIZONS))} FROM priced GROUP BY 1)
SELECT id, {', '.join(f'CASE WHEN p0 > 0 AND p{h} > 0 THEN round(ln(p{h} / p0), 6) END AS ret_{h}h' for h in HORIZONS)} FROM wide""")
def realized_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log returns a day, three days and a week after publication; one in the future counts as published now, and what isn't known is null."""
    t = ticks(spark, sf_dir)
    now = F.broadcast(t.agg(F.max("ts").cast("timestamp").alias("now")))
    shifted = F.timestamp_micros(micros(F.col("ts")) + (F.col("event_id") % 5) * DAY_US)
    e = t.where("asset = 'signup'").crossJoin(now).select(F.col("event_id").alias("id"), F.lit("view").alias("asset"), F.least(shifted, F.col("now")).alias("pub"), F.explode(F.array(*[F.lit(h) for h in (0, *HORIZONS)])).alias("k"))
    priced = price_at(e.withColumn("at", F.timestamp_micros(micros(F.col("pub")) + F.col("k") * HOUR)), t.where("asset = 'view'"), ["id", "k"])
    wide = priced.groupBy("id").agg(*[F.max(F.when(F.col("k") == h, F.col("price"))).alias(f"p{h}") for h in (0, *HORIZONS)])
    return wide.select("id", *[F.round(F.when((F.col("p0") > 0) & (F.col(f"p{h}") > 0), F.log(F.col(f"p{h}") / F.col("p0"))), 6).alias(f"ret_{h}h") for h in HORIZONS])


@query(f"""WITH {DAILY}, r AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r1 FROM daily WINDOW w AS (PARTITION BY asset ORDER BY date)),
v AS (SELECT *, CASE WHEN count(r1) OVER w = 30 THEN round(stddev_samp(r1) OVER w, 9) END AS vol FROM r WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 29 PRECEDING)),
p AS (SELECT *, list(vol) OVER (PARTITION BY asset ORDER BY date ROWS 89 PRECEDING) AS vols FROM v)
SELECT p.asset, p.date, d.date AS week_date, round((p.close / nullif(d.close, 0) - 1) * 100, 4) AS change_7d, round(len(list_filter(vols, lambda x: x <= vol))::DOUBLE / nullif(len(list_filter(vols, lambda x: x IS NOT NULL)), 0) * 100, 4) AS vol_percentile
FROM p ASOF LEFT JOIN daily d ON d.asset = p.asset AND p.date - 7 >= d.date""")
def extended_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's change against the last price a week or more before, and where its volatility stands among the last ninety rows'."""
    d = daily(spark, sf_dir)
    x = indicators(d).select("asset", "date", "close", F.round(F.col("volatility_30d") / F.lit(100) / F.sqrt(F.lit(365.0)), 9).alias("vol"))
    vols = F.collect_list("vol").over(last(90))
    x = x.withColumn("vol_percentile", F.when(F.col("vol").isNotNull(), F.round(F.size(F.filter(vols, lambda v: v <= F.col("vol"))) / F.size(vols) * 100, 4))).withColumn("before", F.date_sub("date", 7))
    week = d.select("asset", "date", F.struct("date", "close").alias("then")).withColumn("o", F.lit(0))
    found = last_before(x, week, "asset", "before", "date", "then", "o")
    return found.select("asset", "date", F.col("then.date").alias("week_date"), F.round((F.try_divide(F.col("close"), F.col("then.close")) - 1) * 100, 4).alias("change_7d"), "vol_percentile")


def time_features(ts: Column, now: Column) -> dict[str, Column]:
    """Hour and weekday as points on circles, flags of weekend, market hours and night, month and quarter, and hours until now."""
    hour, day = F.hour(ts), F.weekday(ts)
    on = lambda f, x, n: F.round(f(x * (2 * 3.141592653589793 / n)) + 3.7e-9, 6)
    return {
        "hours_since": F.round((micros(now) - micros(ts)) / HOUR, 4), "hour": hour, "weekday": day, "is_weekend": (day >= 5).cast("int"), "is_market_hours": hour.between(9, 16).cast("int"), "is_overnight": ((hour < 6) | (hour > 22)).cast("int"),
        "month": F.month(ts), "quarter": F.quarter(ts), "hour_sin": on(F.sin, hour, 24), "hour_cos": on(F.cos, hour, 24), "day_sin": on(F.sin, day, 7), "day_cos": on(F.cos, day, 7)}


_ON = lambda f, x, n: f"round({f}(({x}) * {2 * 3.141592653589793 / n}) + 3.7e-9, 6)"


@query(f"""WITH e AS (SELECT event_id, ts, hour(ts) AS h, isodow(ts) - 1 AS d, (SELECT max(ts) FROM events) AS now_at FROM events)
SELECT event_id, round((epoch_us(now_at) - epoch_us(ts)) / {HOUR}.0, 4) AS hours_since, CAST(h AS INTEGER) AS hour, CAST(d AS INTEGER) AS weekday, CAST(d >= 5 AS INTEGER) AS is_weekend, CAST(h BETWEEN 9 AND 16 AS INTEGER) AS is_market_hours, CAST(h < 6 OR h > 22 AS INTEGER) AS is_overnight,
  CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter, {_ON('sin', 'h', 24)} AS hour_sin, {_ON('cos', 'h', 24)} AS hour_cos, {_ON('sin', 'd', 7)} AS day_sin, {_ON('cos', 'd', 7)} AS day_cos FROM e""")
def temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return e.select("event_id", *[c.alias(k) for k, c in time_features(F.col("ts"), F.col("now")).items()])


@query(f"""WITH er AS ({ORACLES['event_returns']}), {TICKS}, e AS (SELECT event_id AS article_id, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'click' END AS asset, ts FROM events WHERE event_type = 'signup'),
d AS (SELECT article_id, min(abs(epoch_us(p.ts) - epoch_us(e.ts))) / {HOUR}.0 AS diff FROM e JOIN ticks p ON p.asset = e.asset AND p.ts BETWEEN e.ts - INTERVAL 1 HOUR AND e.ts + INTERVAL 1 HOUR GROUP BY 1)
SELECT article_id, {', '.join(f"CASE WHEN asset = '{a}' THEN price_at_pub ELSE 0 END AS {a}_price, CASE WHEN asset = '{a}' THEN round(diff, 6) ELSE 0 END AS {a}_hours_off, {', '.join(f"CASE WHEN asset = '{a}' THEN ret_{h} END AS {a}_ret_{h}" for h in ('4h', '24h', '72h', '7d'))}" for a in ('view', 'click'))} FROM er JOIN d USING (article_id)""")
def market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's market data as columns of its asset: price at publication, how far off in time it was, and the returns after it, which look ahead."""
    er, events, t = event_returns(spark, sf_dir), _events(spark, sf_dir), ticks(spark, sf_dir)
    hit = nearest(events, t.withColumn("us", micros(F.col("ts"))), "asset", "ts", "ts", "us", ["article_id", "asset", "ts"], F.lit(HOUR), 4 * HOUR, "event_id")
    d = hit.select("article_id", (F.abs(F.col("us") - micros(F.col("ts"))) / HOUR).alias("diff"))
    of = lambda a, c, other=0.0: F.when(F.col("asset") == a, F.col(c)).otherwise(other)
    j = er.join(d, "article_id").withColumn("diff", F.round("diff", 6))
    return j.select("article_id", *[x for a in ("view", "click") for x in (of(a, "price_at_pub").alias(f"{a}_price"), of(a, "diff").alias(f"{a}_hours_off"), *[of(a, f"ret_{h}", None).alias(f"{a}_ret_{h}") for h in ("4h", "24h", "72h", "7d")])])
