"""Outcomes: tests of correlation, trades and their extremes, strategies of stored models, and reports of scores by asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.stats import correlation, t_p_value
from millrace.operators.carry import cuts
from millrace.operators.simulate import backtest
from millrace.plans.registry import query
from millrace.plans.returns import facts
from millrace.plans.scores import SCORES, STRATEGIES, _scored, contexts
from millrace.plans.verdicts import stored_predictions


@query()
def correlation_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's r of signal and return by horizon, with the two-sided p of no correlation; null below three articles or without variation."""
    f = facts(spark, sf_dir).where("ret IS NOT NULL AND signal IS NOT NULL").groupBy("days").agg(F.count("*").alias("n"), correlation("signal", "ret").alias("r"))
    t = F.when(F.col("n") > 2, F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))
    return f.withColumn("t", t).withColumn("p", t_p_value()("t", (F.col("n") - 2).cast("double")))


@query()
def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade of the back-tests in one flat row: days held, what it brought on its premium, and its place among its strategy's."""
    t = backtest(contexts(spark, sf_dir), STRATEGIES)
    by = W.partitionBy("asset", "params").orderBy("entry_date", "exit_date", "strike")  # few trades a strategy and asset
    return t.select("asset", "params", F.row_number().over(by).alias("trade"), "entry_date", "exit_date", F.datediff("exit_date", "entry_date").alias("days"), "strike", "premium", "pnl", F.try_divide("pnl", F.abs("premium")).alias("return"), F.when(F.col("pnl") > 0, "win").when(F.col("pnl") < 0, "loss").otherwise("even").alias("outcome"))


@query()
def trade_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst trade, mean win and loss, and their ratio, by strategy and asset."""
    p = F.col("pnl")
    g = trade_summary(spark, sf_dir).groupBy("asset", "params").agg(
        F.count("*").alias("trades"), F.max(p).alias("best"), F.min(p).alias("worst"), F.max_by("entry_date", F.struct(p, "trade")).alias("best_entry"), F.min_by("entry_date", F.struct(p, "trade")).alias("worst_entry"),
        F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.avg(F.when(p > 0, p)).alias("mean_win"), F.avg(F.when(p < 0, p)).alias("mean_loss"), F.avg("days").alias("mean_days"))
    return g.withColumn("payoff", F.try_divide(F.col("mean_win"), -F.col("mean_loss")))


@query()
def model_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What following each stored model would have brought on the articles that it hadn't seen, against holding: by date, the mean of its side times the return."""
    real = facts(spark, sf_dir).where("days = 7 AND ret IS NOT NULL").select("article_id", "asset", "date", "ret")
    p = stored_predictions(spark, sf_dir)
    names = [c for c in p.columns if c.startswith(("p_", "r_"))]
    side = lambda c: F.when(F.col(c) > (0.5 if c.startswith("p_") else 0.0), 1).otherwise(-1)
    each = p.join(real, ["article_id", "asset", "date"]).select("date", "ret", F.explode(F.array(*[F.struct(F.lit(c[2:]).alias("model"), side(c).alias("side")) for c in names])).alias("m"))
    d = each.groupBy("m.model", "date").agg(F.avg(F.col("m.side") * F.col("ret")).alias("x"), F.avg("ret").alias("hold"))
    so_far = W.partitionBy("model").orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # a row for each calendar day
    d = d.withColumn("total", F.sum("x").over(so_far)).withColumn("fall", F.col("total") - F.greatest(F.lit(0.0), F.max("total").over(so_far)))
    g = d.groupBy("model").agg(F.count("*").alias("days"), F.sum("x").alias("total"), F.avg("x").alias("mean"), F.avg((F.col("x") > 0).cast("double")).alias("win_rate"), (F.try_divide(F.avg("x"), F.stddev_pop("x")) * F.sqrt(F.lit(52.0))).alias("sharpe"), F.min("fall").alias("max_drawdown"), F.sum("hold").alias("buy_and_hold"))
    return g.withColumn("excess", F.col("total") - F.col("buy_and_hold"))


_STATS = "count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, CAST(round(min(score), 6) AS DOUBLE) AS least, CAST(round(max(score), 6) AS DOUBLE) AS most, round(avg(confidence), 6) AS confidence"


def _stats() -> list:
    return [F.count("*").alias("n"), *[F.round(f("score"), 6).alias(k) for k, f in (("mean", F.avg), ("sd", F.stddev_pop), ("least", F.min), ("most", F.max))], F.round(F.avg("confidence"), 6).alias("confidence")]


@query(f"""WITH {SCORES}, s AS (SELECT *, round(score, 9) AS s9 FROM scores) SELECT asset, {_STATS}, {', '.join(f'round(avg(CASE WHEN {c} THEN 1.0 ELSE 0 END), 6) AS {k}_ratio' for k, c in (('bullish', 's9 > 0.1'), ('bearish', 's9 < -0.1'), ('neutral', 's9 BETWEEN -0.1 AND 0.1')))} FROM s GROUP BY 1""")
def score_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's scores: moments, and the shares of bullish, bearish and neutral ones."""
    s = F.round("score", 9)
    share = lambda c, k: F.round(F.avg(c.cast("double")), 6).alias(f"{k}_ratio")
    return _scored(spark, sf_dir).groupBy(F.col("event_type").alias("asset")).agg(*_stats(), share(s > 0.1, "bullish"), share(s < -0.1, "bearish"), share(s.between(-0.1, 0.1), "neutral"))


_BINS = {"strong_bullish": "s9 > 0.4", "bullish": "s9 > 0.1 AND s9 <= 0.4", "neutral": "s9 >= -0.1 AND s9 <= 0.1", "bearish": "s9 >= -0.4 AND s9 < -0.1", "strong_bearish": "s9 < -0.4"}


@query(f"""WITH {SCORES}, s AS (SELECT *, round(score, 9) AS s9, round(confidence, 9) AS c9 FROM scores) SELECT asset, {_STATS}, {', '.join(f'count(*) FILTER ({c}) AS {k}' for k, c in _BINS.items())} FROM s WHERE c9 > 0.2 GROUP BY 1""")
def production_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's scores of enough confidence, and how they fall into five bins."""
    s = _scored(spark, sf_dir).withColumns({"s9": F.round("score", 9), "c9": F.round("confidence", 9)}).where("c9 > 0.2")
    return s.groupBy(F.col("event_type").alias("asset")).agg(*_stats(), *[F.count_if(F.expr(c)).alias(k) for k, c in _BINS.items()])


_CUTS = (1, 5, 50, 95, 99)


@query(f"WITH {SCORES} SELECT {', '.join(f'round(quantile_cont(score, {p / 100}), 6) AS p{p}' for p in _CUTS)} FROM scores")
def exact_score_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of all scores in one row."""
    out = cuts(_scored(spark, sf_dir), "score", {f"p{p}": p / 100 for p in _CUTS})
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
