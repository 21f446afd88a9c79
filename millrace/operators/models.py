"""Fitted pipelines that are stored, read back and applied to new records.

A pipeline holds everything from raw columns to the prediction: what stands for missing values (medians of the training rows' calendar), indices of
the categories (one more for those never seen), interactions, scaling, and the model, so records are scored by what was fitted.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ["bias", "theme", "asset"]
CALENDAR = ["f_weekday", "f_month", "f_quarter"]
NUMBERS = ["f_signal", "f_signal2", "f_log", "f_confidence", "f_both"]
_DERIVED = """SELECT *, coalesce(signal, 0.5) AS f_signal, pow(coalesce(signal, 0.5), 2) AS f_signal2, ln(greatest(coalesce(signal, 0.5), 0) + 1e-6) AS f_log, coalesce(confidence, 0.5) AS f_confidence,
  coalesce(confidence, 0.5) * coalesce(signal, 0.5) AS f_both, CAST(weekday(date) AS DOUBLE) AS r_weekday, CAST(month(date) AS DOUBLE) AS r_month, CAST(quarter(date) AS DOUBLE) AS r_quarter FROM __THIS__"""


def models(seed: int = 1, trees: int = 30) -> dict[str, Estimator]:
    """By name: classifiers of `label` (0 or 1) and regressors of `ret`."""
    return {
        "boosted_trees": GBTClassifier(maxIter=trees, maxDepth=4, stepSize=0.1, seed=seed),
        "forest": RandomForestClassifier(numTrees=trees, maxDepth=6, seed=seed),
        "logistic": LogisticRegression(maxIter=50),
        "boosted_return": GBTRegressor(labelCol="ret", maxIter=trees, maxDepth=3, stepSize=0.1, seed=seed),
        "forest_return": RandomForestRegressor(labelCol="ret", numTrees=trees, maxDepth=6, seed=seed),
    }


def pipeline(model: Estimator) -> Pipeline:
    """Raw records (signal, confidence, date, bias, theme, asset; any of them null) to predictions of the model."""
    return Pipeline(stages=[*preparation(), model])


def preparation() -> list:
    """The steps from raw records to `features`, the same for every model."""
    return [
        SQLTransformer(statement=_DERIVED),
        Imputer(strategy="median", inputCols=[c.replace("f_", "r_") for c in CALENDAR], outputCols=CALENDAR),
        StringIndexer(inputCols=CATEGORIES, outputCols=[f"i_{c}" for c in CATEGORIES], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"i_{c}" for c in CATEGORIES], outputCols=[f"o_{c}" for c in CATEGORIES], handleInvalid="keep"),
        VectorAssembler(inputCols=[*NUMBERS, *CALENDAR, *[f"o_{c}" for c in CATEGORIES]], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features"),
    ]


def fit_and_store(train: DataFrame, path: str, kinds: dict[str, Estimator]) -> None:
    """Fit each model on train (raw columns, label and ret) and write its pipeline to path/name; what prepares the records is fitted once."""
    prepared = Pipeline(stages=preparation()).fit(train)
    ready = prepared.transform(train)
    for name, model in kinds.items():
        PipelineModel(stages=[*prepared.stages, model.fit(ready)]).write().overwrite().save(f"{path}/{name}")


def load(path: str, names: list[str]) -> dict[str, PipelineModel]:
    return {n: PipelineModel.load(f"{path}/{n}") for n in names}


def scored(records: DataFrame, stored: dict[str, PipelineModel]) -> DataFrame:
    """records with p_<name> for each classifier, its probability of label 1, and r_<name> for each regressor, its expected return.

    Every record gets its scores in one pass; categories that weren't seen in training count as one further category.
    """
    columns, out = records.columns, records
    for name, model in stored.items():
        now = model.transform(out)
        value = vector_to_array("probability")[1].alias(f"p_{name}") if "probability" in now.columns else F.col("prediction").alias(f"r_{name}")
        columns = [*columns, f"p_{name}" if "probability" in now.columns else f"r_{name}"]
        out = now.select(*columns[:-1], value)
    return out


def consensus(p: list[Column]) -> dict[str, Column]:
    """Several models' probabilities as one: mean, deviation, how far they agree, and the side they are on."""
    mean = sum(p, F.lit(0.0)) / len(p)
    sd = F.sqrt(sum(((x - mean) * (x - mean) for x in p), F.lit(0.0)) / len(p))
    agreement = F.when(sd < 0.1, "high").when(sd < 0.2, "medium").otherwise("low")
    advice = F.when((mean > 0.6) & (agreement == "high"), "strong_buy").when((mean < 0.4) & (agreement == "high"), "strong_sell").when(F.abs(mean - 0.5) > 0.1, "weak_signal").otherwise("neutral")
    return {"probability": mean, "deviation": sd, "agreement": agreement, "consensus": F.when(mean > 0.5, "bullish").otherwise("bearish"), "advice": advice}


def predictions(spark: SparkSession, records: DataFrame, path: str, names: list[str]) -> DataFrame:
    """records scored by the pipelines stored at path, and the consensus of the classifiers among them."""
    out = scored(records, load(path, names))
    both = consensus([F.col(c) for c in out.columns if c.startswith("p_")])
    return out.select("*", *[c.alias(k) for k, c in both.items()])
