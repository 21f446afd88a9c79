"""Stored pipelines: what is read back predicts the same, learns what is there to learn, and takes records it has never seen the like of."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.models import consensus, fit_and_store, load, models, predictions, scored
from millrace.sources.scratch import fresh

SCHEMA = "article_id long, asset string, date date, theme string, bias string, signal double, confidence double, ret double, label double"


def records(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        bias, signal = rng.choice(["bullish", "bearish", "neutral"]), rng.random()
        ret = (0.1 * signal if bias == "bullish" else -0.1 * signal if bias == "bearish" else 0) + rng.gauss(0, 0.01)
        out.append((i, rng.choice("xyz"), dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(300)), rng.choice(["t1", "t2"]), bias, signal, rng.random(), ret, float(ret > 0)))
    return out


@pytest.fixture(scope="module")
def stored(spark):
    path, kinds = fresh(spark, "models"), models(trees=5)
    fit_and_store(spark.createDataFrame(records(400, 1), SCHEMA), path, kinds)
    return path, list(kinds)


def test_new_records_are_predicted(spark, stored):
    new = spark.createDataFrame(records(300, 2), SCHEMA)
    got = predictions(spark, new, *stored).collect()
    sided = [r for r in got if r.bias != "neutral" and r.signal > 0.3]
    for name in ("boosted_trees", "forest", "logistic"):
        assert sum((r[f"p_{name}"] > 0.5) == (r.label == 1) for r in sided) > 0.95 * len(sided), name
    for name in ("boosted_return", "forest_return"):
        assert sum((r[f"r_{name}"] > 0) == (r.ret > 0) for r in sided) > 0.95 * len(sided), name
    again = {r.article_id: r for r in scored(new, load(*stored)).collect()}
    assert all(again[r.article_id].p_forest == r.p_forest and again[r.article_id].r_forest_return == r.r_forest_return for r in got)
    for r in got:
        p = [r.p_boosted_trees, r.p_forest, r.p_logistic]
        assert r.probability == pytest.approx(sum(p) / 3) and r.consensus == ("bullish" if sum(p) > 1.5 else "bearish")


def test_unseen_categories_and_missing_values(spark, stored):
    odd = spark.createDataFrame([(1, "never", dt.date(2030, 1, 1), "seen nowhere", "sideways", 0.5, 0.5), (2, None, None, None, None, None, None), (3, "x", None, "t1", "bullish", -1.0, 2.0)], "article_id long, asset string, date date, theme string, bias string, signal double, confidence double")
    got = predictions(spark, odd, *stored).collect()
    assert len(got) == 3 and all(0 <= r[c] <= 1 for r in got for c in ("p_boosted_trees", "p_forest", "p_logistic"))
    assert predictions(spark, odd.limit(0), *stored).collect() == []


def test_consensus(spark):
    df = spark.createDataFrame([(0.9, 0.85, 0.95), (0.1, 0.2, 0.15), (0.9, 0.1, 0.9), (0.5, 0.5, 0.5)], "a double, b double, c double")
    got = df.select(*[c.alias(k) for k, c in consensus([F.col(x) for x in "abc"]).items()]).collect()
    assert [(r.agreement, r.advice) for r in got] == [("high", "strong_buy"), ("high", "strong_sell"), ("low", "weak_signal"), ("high", "neutral")]


def test_training_runs(spark, tmp_path):
    from millrace.plans.verdicts import training_run

    rows = {r.stage: r for r in training_run(spark, "/root/testdata/sf0.001").collect()}
    assert list(rows) == ["data_collection", "label_generation", "model_training", "ensemble_validation"]
    assert all(r.status == "success" for r in rows.values()) and 0 <= rows["ensemble_validation"].value <= 1
    assert rows["model_training"].rows + rows["ensemble_validation"].rows == rows["label_generation"].rows
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(0).write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.status for r in training_run(spark, str(tmp_path)).collect()] == ["failed", "skipped", "skipped", "skipped"]


def test_preparation_is_fitted_once(spark, tmp_path, monkeypatch):
    """For all models together; each stored pipeline is what its own fit would have been."""
    import datetime as dt

    from millrace.operators import models as M

    rows = [(i / 40, (i * 7 % 10) / 10, dt.date(2024, 1 + i % 12, 1 + i % 28), "abc"[i % 3], "xy"[i % 2], "pq"[i % 2], float(i * 13 % 5 > 2), i * 13 % 5 / 5) for i in range(40)]
    train = spark.createDataFrame(rows, "signal double, confidence double, date date, bias string, theme string, asset string, label double, ret double").coalesce(1)
    kinds = {k: m for k, m in M.models(trees=3).items() if k in ("logistic", "forest", "forest_return")}
    fits, real = [], M.Imputer._fit
    monkeypatch.setattr(M.Imputer, "_fit", lambda self, df: fits.append(1) or real(self, df))
    M.fit_and_store(train, str(tmp_path), kinds)
    assert len(fits) == 1
    for name, model in M.load(str(tmp_path), list(kinds)).items():
        own = M.pipeline(kinds[name]).fit(train).transform(train).select("prediction").collect()
        assert model.transform(train).select("prediction").collect() == own
