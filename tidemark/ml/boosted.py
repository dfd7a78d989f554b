"""ML1-ML4: boosted trees for fills and event rates, and validation by blocks of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the models: trees, depth, step, share of rows, rows in a leaf.
FILL = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 50}
EVENT_RATE = {"maxIter": 300, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 100}


def classifier(train: DataFrame, features: Sequence[str], label: str, seed: int = 42, **params) -> PipelineModel:
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **({**FILL, **params}))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), gbt]).fit(train)


def fill_pair(train: DataFrame, features: Sequence[str], won: str = "won", filled: str = "filled", **params) -> tuple[PipelineModel, PipelineModel]:
    """ML1: chances of a fill among winning and among losing orders."""
    return classifier(train.where(won), features, filled, **params), classifier(train.where(f"NOT {won}"), features, filled, **params)


def regressor(train: DataFrame, features: Sequence[str], label: str, seed: int = 42, **params) -> PipelineModel:
    """ML3: a share filled. Squared loss stands in for cross entropy; compare by error and calibration."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, **({**FILL, **params}))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), gbt]).fit(train)


def probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    p = vector_to_array("probability")[1] if "probability" in out.columns else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
    return out.withColumn("predicted", p).select(*rows.columns, "predicted")


def with_day(rows: DataFrame, time_us: str) -> DataFrame:
    """Q42: rows with `day`, counted from 1 at the first row's."""
    day = F.floor(F.col(time_us) / 86_400_000_000)
    return rows.crossJoin(rows.agg(F.min(day).alias("_first"))).withColumn("day", day - F.col("_first") + 1).drop("_first")


def blocked_folds(rows: DataFrame, day: str, test_days: Sequence[int] = (4, 5, 6)) -> list[tuple[DataFrame, DataFrame]]:
    """ML4: for each test day the rows of all days before it, and its own."""
    return [(rows.where(F.col(day) < d), rows.where(F.col(day) == d)) for d in test_days]


def by_group(scored: DataFrame, key: str | None, observed: str) -> DataFrame:
    """Predicted and observed means of each group, and the mean absolute error."""
    keys = [key] if key else []
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("predicted").alias("predicted"), F.avg(F.col(observed).cast("double")).alias("observed"), F.avg(F.abs(F.col("predicted") - F.col(observed).cast("double"))).alias("mae"))


def baseline_error(rows: DataFrame, keys: Sequence[str], observed: str) -> DataFrame:
    """The mean absolute error of predicting each group's mean."""
    mean = F.avg(observed).over(Window.partitionBy(*keys))
    return rows.select(F.abs(F.col(observed) - mean).alias("e")).agg(F.avg("e").alias("baseline_mae"))
