"""Feature importance by three models, and what is done with it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import LABEL
from ..session import SMALL_GROUPS, stored
from .encode import standard_scale


def _assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(features, label) with missing values as 0, ready for Spark ML."""
    filled = df.filter(F.col(label).isNotNull()).select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
        F.col(label).cast("double").alias("_label"))
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    return assembler.transform(filled).select("_features", "_label")


def _scaled(df: DataFrame, features: list[str], label: str) -> tuple[DataFrame, list[str]]:
    rows = df.filter(F.col(label).isNotNull()).select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
        F.col(label).alias("_y"))
    scaled, scale = standard_scale(rows, features)
    return scaled, [*scale.scaled, *scale.untouched]


def _table(df: DataFrame, features: Iterable[str], values: Iterable[float]) -> DataFrame:
    """One row per feature; the list is as long as the table is wide."""
    rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    table = df.sparkSession.createDataFrame(rows, "Feature string, Importance double")
    return table.orderBy(F.desc("Importance"), "Feature")


def rf_importance(
    df: DataFrame, features: list[str], label: str = LABEL, trees: int = 100, seed: int = 42
) -> DataFrame:
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", numTrees=trees, seed=seed)
    model = forest.fit(_assembled(df, features, label))
    return _table(df, features, model.featureImportances.toArray())


def logistic_importance(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """Absolute coefficients on scaled data; the penalty equals C = 1."""
    scaled, names = _scaled(df, features, label)
    data = _assembled(scaled, names, "_y").persist()
    model = LogisticRegression(
        featuresCol="_features", labelCol="_label", maxIter=1000, standardization=False,
        regParam=1.0 / max(data.count(), 1)).fit(data)
    data.unpersist()
    return _table(df, names, abs(model.coefficientMatrix.toArray()[0]))


def svc_importance(
    df: DataFrame, features: list[str], label: str = LABEL, max_iter: int = 1000
) -> DataFrame:
    """Absolute coefficients of a linear SVM, the mean over classes if several.

    The loss is the plain hinge: compare ranks with other libraries, not values.
    """
    scaled, names = _scaled(df, features, label)
    data = _assembled(scaled, names, "_y").persist()
    svc = LinearSVC(featuresCol="_features", labelCol="_label", maxIter=max_iter,
                    tol=1e-4, standardization=False, regParam=1.0 / max(data.count(), 1))
    classes = data.select("_label").distinct().count()
    if classes > 2:
        models = OneVsRest(classifier=svc, featuresCol="_features", labelCol="_label").fit(
            data).models
        values = sum(abs(m.coefficients.toArray()) for m in models) / len(models)
    else:
        values = abs(svc.fit(data).coefficients.toArray())
    data.unpersist()
    return _table(df, names, values)


def normalise_importance(importance: DataFrame) -> DataFrame:
    """Importance on a 0-1 scale; all equal gives 1."""
    bounds = C.only_row(
        importance.agg(F.min("Importance").alias("lo"), F.max("Importance").alias("hi")))
    width = bounds["hi"] - bounds["lo"]
    scaled = F.when(width > 0, (F.col("Importance") - bounds["lo"]) / width).otherwise(1.0)
    return importance.withColumn("Importance", scaled)


def importance_join(rf: DataFrame, logistic: DataFrame, svc: DataFrame) -> DataFrame:
    """The three tables side by side, one row per feature."""
    named = [
        df.select("Feature", F.col("Importance").alias(name))
        for df, name in ((rf, "RF_Importance"), (logistic, "Log_Importance"),
                         (svc, "SVC_Importance"))
    ]
    return named[0].join(named[1], "Feature", "full").join(named[2], "Feature", "full")


def average_importance(joined: DataFrame) -> DataFrame:
    """Add the mean of the known importances, best first."""
    columns = ["RF_Importance", "Log_Importance", "SVC_Importance"]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    known = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return joined.withColumn("Average_Importance", F.try_divide(total, known)).orderBy(
        F.desc("Average_Importance"), "Feature")


def combine_importance(rf: DataFrame, logistic: DataFrame, svc: DataFrame) -> DataFrame:
    scaled = [normalise_importance(df) for df in (rf, logistic, svc)]
    return average_importance(importance_join(*scaled))


def aggregate_importance(
    df: DataFrame, features: list[str], label: str = LABEL, trees: int = 100,
    max_iter: int = 1000,
) -> DataFrame:
    """All three models on one table, joined and averaged.

    Each model reads the table several times; they read its few columns as stored once.
    """
    df = stored(df.filter(F.col(label).isNotNull()).select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], label),
        "importance", **SMALL_GROUPS)
    return combine_importance(
        rf_importance(df, features, label, trees), logistic_importance(df, features, label),
        svc_importance(df, features, label, max_iter))
