"""Per-project encoding and scaling, with the fitted tables kept as tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schema import PERIODS, PROJECT, SCALED
from .timeline import Timeline


def _as_text(column: str) -> Column:
    # a missing value is the text 'nan', as its string form is there
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def label_dictionary(
    df: DataFrame, columns: Iterable[str], project: str = PROJECT
) -> DataFrame:
    """(project, column, value, code): codes count sorted distinct values from 0.

    Distinct values are found first, on the map side; only they are ordered.
    """
    columns = list(columns)
    values = (
        df.select(project, *[_as_text(c).alias(c) for c in columns])
        .filter(F.col(project).isNotNull())
        .unpivot([project], columns, "column", "value")
        .distinct()
    )
    line = Timeline.of(values, [project, "column"], ["value"]).position("code")
    return line.frame().withColumn("code", (F.col("code") - 1).cast("int"))


def label_encode(
    df: DataFrame, columns: Iterable[str], project: str = PROJECT
) -> tuple[DataFrame, DataFrame]:
    """(rows with codes, dictionary)."""
    columns = list(columns)
    encoded = df.filter(F.col(project).isNotNull())
    for c in columns:
        codes = label_dictionary(df, [c], project).select(
            project, F.col("value").alias("_text"), F.col("code").alias("_code"))
        encoded = (
            encoded.withColumn("_text", _as_text(c))
            .join(codes, [project, "_text"], "left")
            .withColumn(c, F.col("_code"))
            .drop("_text", "_code")
        )
    return encoded.select(*df.columns), label_dictionary(df, columns, project)


def minmax_table(df: DataFrame, columns: Iterable[str], project: str = PROJECT) -> DataFrame:
    """(project, <column>_min, <column>_max ...): the fitted scaler."""
    bounds = [a for c in columns for a in (
        F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max"))]
    return df.filter(F.col(project).isNotNull()).groupBy(project).agg(*bounds)


def minmax_apply(
    df: DataFrame, scaler: DataFrame, columns: Iterable[str], project: str = PROJECT
) -> DataFrame:
    """Scale rows with a fitted table; rows it was not fitted on may leave [0, 1]."""
    columns = list(columns)

    def scaled(c: str) -> Column:
        value = F.col(c).cast("double")
        low, high = F.col(f"{c}_min"), F.col(f"{c}_max")
        # a constant column has scale 1
        return (value - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))

    joined = df.join(scaler, project)
    return joined.withColumns({c: scaled(c) for c in columns}).select(*df.columns)


def minmax_scale(
    df: DataFrame, columns: Iterable[str] = SCALED, project: str = PROJECT
) -> tuple[DataFrame, DataFrame]:
    """(scaled rows, scaler table); columns the table lacks are skipped."""
    columns = [c for c in columns if c in df.columns]
    scaler = minmax_table(df, columns, project)
    return minmax_apply(df, scaler, columns, project), scaler


def cyclical_encode(
    df: DataFrame, columns: Iterable[str], periods: Mapping[str, float] = PERIODS
) -> DataFrame:
    """Replace time columns by their sine and cosine."""
    chosen = [c for c in columns if c in df.columns and c in periods]
    added = {}
    for c in chosen:
        added[f"{c}_sin"], added[f"{c}_cos"] = C.cyclical(F.col(c), periods[c])
    return df.withColumns(added).drop(*chosen) if chosen else df


@dataclass(frozen=True)
class StandardScale:
    """A fitted scaler: which columns it scales, and one row of mean and sd."""

    scaled: list[str]
    untouched: list[str]
    table: DataFrame


def fit_standard_scale(
    df: DataFrame, features: Iterable[str], one_hot_prefixes: Iterable[str] = ()
) -> StandardScale:
    """Means and population deviations of the columns that are not 0/1 flags."""
    features = list(features)
    one_hot = [c for c in features if any(c.startswith(p) for p in one_hot_prefixes)]
    checked = [c for c in features if c not in one_hot]
    # a flag has exactly the values 0 and 1, and no null
    tests = [
        (F.min(c).eqNullSafe(F.lit(0)) & F.max(c).eqNullSafe(F.lit(1))
         & (F.count_if(F.coalesce(~F.col(c).isin(0, 1), F.lit(True))) == 0)).alias(c)
        for c in checked
    ]
    flags = df.agg(*tests).first() if tests else {}
    binary = [c for c in checked if flags[c]]
    scaled = [c for c in checked if c not in binary]
    moments = [a for c in scaled for a in (
        F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"))]
    table = df.agg(*moments) if moments else df.agg(F.count(F.lit(1)).alias("rows"))
    return StandardScale(scaled, one_hot + binary, table)


def apply_standard_scale(df: DataFrame, scale: StandardScale) -> DataFrame:
    """Scaled columns first, then the flags, after any other columns."""
    def scaled(c: str) -> Column:
        sd = fitted[f"{c}_sd"]
        return ((F.col(c) - fitted[f"{c}_mean"]) / F.when(sd > 0, sd).otherwise(F.lit(1.0))).alias(c)

    rest = [c for c in df.columns if c not in scale.scaled and c not in scale.untouched]
    if not scale.scaled:
        return df.select(*rest, *scale.untouched)
    fitted = C.only_row(scale.table)
    return df.select(*rest, *[scaled(c) for c in scale.scaled], *scale.untouched)


def standard_scale(
    df: DataFrame, features: Iterable[str], one_hot_prefixes: Iterable[str] = (),
    scale: StandardScale | None = None,
) -> tuple[DataFrame, StandardScale]:
    scale = scale or fit_standard_scale(df, features, one_hot_prefixes)
    return apply_standard_scale(df, scale), scale


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
