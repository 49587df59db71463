"""Labels, cleaning and imputation of job rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schema import (
    COMMITTER, LABEL, MEAN_FILLED, MEDIAN_FILLED, PROJECT, STARTED, TIME_ORDER, ZERO_FILLED,
)
from .timeline import Timeline, exact_quantiles


def drop_unnamed(df: DataFrame, project: str = PROJECT) -> tuple[DataFrame, DataFrame]:
    """Rows with a project, and a one-row count of those without."""
    missing = df.agg(F.count_if(F.col(project).isNull()).alias("rows_without_project"))
    return df.filter(F.col(project).isNotNull()), missing


def status_to_label(df: DataFrame, status_col: str = "tr_status") -> DataFrame:
    """Replace a status column by the 0/1 label; rows of any other status go."""
    label = C.label_of_status(F.col(status_col), df.schema[status_col].dataType)
    return df.withColumn(LABEL, label).dropna(subset=[LABEL]).drop(
        *([status_col] if status_col != LABEL else [])
    )


def filter_status(df: DataFrame, status_col: str = "tr_status") -> DataFrame:
    """Keep finished builds and add the label, keeping the status."""
    kept = df.filter(F.col(status_col).isin(*C.PASSED, *C.FAILED))
    return kept.withColumn(LABEL, C.label_of_status(F.col(status_col), T.StringType()))


def normalise_bool_text(df: DataFrame, column: str = COMMITTER) -> DataFrame:
    return df.withColumn(column, C.bool_text(F.col(column).cast("string")))


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    skip = {PROJECT, STARTED, *skip}
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def select_numeric_features(
    df: DataFrame, target: str = LABEL, include_label: bool = False, keep: Iterable[str] = ()
) -> tuple[DataFrame, list[str], list[str]]:
    """(rows of ``keep`` + numeric features + label, features, discarded names).

    With ``include_label`` the label is also one of the features, which is
    what sequence windows use (they only look at earlier rows).
    """
    features = numeric_columns(df, skip=[] if include_label else [target])
    discarded = [
        f.name for f in df.schema
        if not isinstance(f.dataType, T.NumericType) and f.name not in (PROJECT, STARTED)
    ]
    chosen = [*keep, *[c for c in features if c not in set(keep) | {target}], target]
    return df.select(*chosen), features, discarded


def drop_low_importance(
    df: DataFrame, importance: DataFrame, threshold: float = 0.001
) -> tuple[DataFrame, list[str]]:
    """Drop features below a mean importance. The list is one name per column."""
    low = importance.filter(F.col("Average_Importance") < threshold).select("Feature")
    names = sorted(r[0] for r in low.collect())
    return df.drop(*names), names


def coerce_numeric(
    df: DataFrame, column: str, dropna: bool = True, project: str = PROJECT,
    order: list[str] | None = None,
) -> DataFrame:
    """The numeric series of a column per project, numbered from 0 as ``x``."""
    numbers = df.withColumn(column, C.number(F.col(column)))
    if dropna:
        numbers = numbers.filter(F.col(column).isNotNull())
    else:
        numbers = numbers.fillna(0.0, [column])
    line = Timeline.of(numbers, [project], order or TIME_ORDER).position("x")
    return line.frame().withColumn("x", F.col("x") - 1)


def num_files_edited(df: DataFrame) -> DataFrame:
    return df.withColumn("num_files_edited", C.edited_files(
        F.col("gh_diff_files_added"), F.col("gh_diff_files_deleted"),
        F.col("gh_diff_files_modified")))


def no_config_edited(df: DataFrame) -> DataFrame:
    return df.withColumn("no_config_edited", C.config_flag(F.col("gh_diff_doc_files")))


# -- imputation ---------------------------------------------------------------
def impute_zero(df: DataFrame, columns: Iterable[str] = ZERO_FILLED) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in present})


def project_means(df: DataFrame, columns: Iterable[str], project: str = PROJECT) -> DataFrame:
    return df.groupBy(project).agg(*[F.avg(c).alias(f"{c}__fill") for c in columns])


def project_mode(df: DataFrame, column: str, project: str = PROJECT) -> DataFrame:
    """Most frequent value per project, the smallest one on ties."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(project, column).count()
    best = F.min_by(column, F.struct(-F.col("count"), F.col(column)))
    return counts.groupBy(project).agg(best.alias(f"{column}__fill"))


def project_medians(
    df: DataFrame, columns: Iterable[str], project: str = PROJECT
) -> DataFrame:
    """Exact medians of several columns per project, in one pass."""
    columns = list(columns)
    long = df.select(project, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [project], columns, "_column", "_value")
    medians = exact_quantiles(long, [project, "_column"], "_value", [0.5], ["_median"])
    return medians.groupBy(project).agg(*[
        F.max(F.when(F.col("_column") == c, F.col("_median"))).alias(f"{c}__fill")
        for c in columns])


def _fill(df: DataFrame, fills: list[DataFrame], defaults: dict, project: str) -> DataFrame:
    """One join of all per-project statistics, whose size AQE checks at run time."""
    table = fills[0]
    for other in fills[1:]:
        table = table.join(other, project, "full")
    joined = df.join(table, project, "left")
    filled = {
        c: F.coalesce(F.col(c), F.col(f"{c}__fill"), F.lit(default))
        for c, default in defaults.items()
    }
    return joined.withColumns(filled).select(*df.columns)


def impute_mean(
    df: DataFrame, columns: Iterable[str] = MEAN_FILLED, project: str = PROJECT
) -> DataFrame:
    columns = [c for c in columns if c in df.columns]
    return _fill(df, [project_means(df, columns, project)], dict.fromkeys(columns, 0.0), project)


def impute_mode(df: DataFrame, column: str = COMMITTER, project: str = PROJECT) -> DataFrame:
    default = 0.0 if isinstance(df.schema[column].dataType, T.NumericType) else "0"
    return _fill(df, [project_mode(df, column, project)], {column: default}, project)


def impute_median(
    df: DataFrame, defaults: dict[str, float] | None = None, project: str = PROJECT
) -> DataFrame:
    defaults = {c: d for c, d in (defaults or MEDIAN_FILLED).items() if c in df.columns}
    return _fill(df, [project_medians(df, defaults, project)], defaults, project)


def impute_interpolate(
    df: DataFrame, column: str = "tr_duration", project: str = PROJECT,
    order: list[str] | None = None, line: Timeline | None = None,
) -> DataFrame:
    """Linear interpolation by row position; both ends take the nearest value."""
    line = line or Timeline.of(df, [project], order or TIME_ORDER)
    return interpolate(line, column).frame()


def interpolate(line: Timeline, column: str) -> Timeline:
    line = line.position("_at").rebased()
    known = F.when(F.col(column).isNotNull(), F.struct(
        F.col(column).cast("double").alias("v"), F.col("_at").alias("at")))
    line = line.nearest_known("_past", "_next", known)
    past, coming = F.col("_past"), F.col("_next")
    slope = F.try_divide(coming["v"] - past["v"], coming["at"] - past["at"])
    value = F.coalesce(
        F.col(column).cast("double"),
        past["v"] + slope * (F.col("_at") - past["at"]),
        past["v"],
        coming["v"],
        # rows without a project stay as they are
        F.when(F.col("_at").isNotNull(), F.lit(0.0)),
    )
    return line.map(lambda rows: rows.withColumn(column, value).drop("_at", "_past", "_next"))


def impute(df: DataFrame, project: str = PROJECT, line: Timeline | None = None) -> DataFrame:
    """All imputation rules: one statistics join and one ordered pass."""
    line = line or Timeline.of(df, [project], TIME_ORDER)
    means = [c for c in MEAN_FILLED if c in df.columns]
    medians = {c: d for c, d in MEDIAN_FILLED.items() if c in df.columns}
    fills = [project_mode(df, COMMITTER, project)]
    fills += [project_means(df, means, project)] if means else []
    fills += [project_medians(df, medians, project)] if medians else []
    flag = 0.0 if isinstance(df.schema[COMMITTER].dataType, T.NumericType) else "0"
    ordered = interpolate(line, "tr_duration").frame() if "tr_duration" in df.columns else df
    filled = _fill(
        ordered, fills, {**dict.fromkeys(means, 0.0), **medians, COMMITTER: flag}, project
    )
    return impute_zero(filled)
