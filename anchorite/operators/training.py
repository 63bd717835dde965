"""Fitting of the ranker and the linker, and their use as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def largest(samples: DataFrame, names: list[str]) -> dict[str, float]:
    """Largest absolute value of each feature, 1 where it is 0 or unknown: one pass, one row."""
    row = samples.agg(*[F.max(F.abs(n)).alias(n) for n in names]).first()
    return {n: float(row[n] or 1.0) for n in names}


def scaled(samples: DataFrame, scale: dict[str, float]) -> DataFrame:
    """Features divided by their scales; a null counts as 0."""
    return samples.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) / s for n, s in scale.items()})


def signed(samples: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Differences of gold and other candidates with labels 1 or 0: a hash of the keys turns about half of them round."""
    flip = F.xxhash64(*keys) % 2 == 0
    return samples.withColumns({n: F.when(flip, -F.col(n)).otherwise(F.col(n)) for n in names}).withColumn("label", F.when(flip, 0.0).otherwise(1.0))


def fit(samples: DataFrame, names: list[str], costs: tuple[float, ...] = (0.01, 0.1, 1.0), tolerances: tuple[float, ...] = (1e-4,), folds: int = 5, seed: int = 31) -> LinearSVCModel:
    """A linear model of ``label`` (0 or 1): the best of a grid by accuracy over folds, then fitted on all samples."""
    data = VectorAssembler(inputCols=names, outputCol="features").transform(samples).select("label", "features")
    svm = LinearSVC(maxIter=50)
    grid = ParamGridBuilder().addGrid(svm.regParam, list(costs)).addGrid(svm.tol, list(tolerances)).build()
    if len(grid) == 1:
        return svm.fit(data, grid[0])
    return CrossValidator(estimator=svm, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=seed, parallelism=2).fit(data).bestModel


def score(model: LinearSVCModel, names: list[str]) -> Column:
    """The model's margin as an expression: it stays in generated code."""
    terms = [F.col(n) * float(w) for n, w in zip(names, model.coefficients, strict=True)]
    return reduce(lambda a, b: a + b, terms, F.lit(float(model.intercept)))
