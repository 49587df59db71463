"""Profiles and aggregates of job tables and metric entries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schema import (
    BUILD_FIRSTS, BUILD_MAXIMA, BUILD_MEANS, BUILD_SUMS, LABEL, PROJECT, STARTED, TIME_ORDER,
)
from .timeline import exact_quantiles

ENTRY_METRICS = ["F1", "AUC", "accuracy", "PR_AUC"]


def _is_null(column: str) -> Column:
    return F.col(column).isNull().cast("int")


def _long(df: DataFrame, names: Iterable[str], key: str, value: str) -> DataFrame:
    """One row with a column per name -> one row per name."""
    return df.unpivot([], list(names), key, value)


def project_summary(
    df: DataFrame, min_rows: int = 10_000, balance: float = 0.6, project: str = PROJECT
) -> DataFrame:
    """Rows, missing share and class shares of large, balanced projects."""
    nulls = sum((_is_null(c) for c in df.columns), F.lit(0))
    label = F.col(LABEL)
    cells = F.col("num_rows") * len(df.columns)
    stats = df.groupBy(F.col(project).alias("project")).agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.sum(nulls).alias("_nulls"),
        F.count(label).alias("_labels"),
        F.count_if(label == 0).alias("_passed"),
        F.count_if(label == 1).alias("_failed"),
    ).filter(F.col("project").isNotNull() & (F.col("num_rows") >= min_rows))
    passed = F.try_divide(F.col("_passed"), F.col("_labels"))
    failed = F.try_divide(F.col("_failed"), F.col("_labels"))
    return (
        stats.filter((F.col("_labels") > 0) & (F.greatest(passed, failed) <= balance))
        .select(
            "project",
            "num_rows",
            C.ratio4(F.col("_nulls") / cells).alias("missing_ratio"),
            C.ratio4(passed).alias("passed_ratio"),
            C.ratio4(failed).alias("failed_ratio"),
        )
        .orderBy(F.desc("num_rows"), "project")
    )


def jobs_to_builds(
    df: DataFrame,
    sums: Iterable[str] = BUILD_SUMS,
    means: Iterable[str] = BUILD_MEANS,
    maxima: Iterable[str] = BUILD_MAXIMA,
    firsts: Iterable[str] = BUILD_FIRSTS,
    job: str = "tr_job_id",
) -> DataFrame:
    """Merge the jobs of a build; rules for absent columns are skipped.

    "First" is the first non-null value by job id, then by value, so it does
    not depend on row order.
    """
    keys = [PROJECT, STARTED, LABEL, "tr_build_id"]
    here = set(df.columns)
    measures = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums if c in here]
    measures += [F.avg(c).alias(c) for c in means if c in here]
    measures += [F.max(c).alias(c) for c in maxima if c in here]
    for c in firsts:
        if c in here:
            rank = F.when(F.col(c).isNotNull(), F.struct(job, c))
            measures.append(F.min_by(c, rank).alias(c))
    # groups with a null key are dropped
    known = df.dropna(subset=keys)
    return known.groupBy(*keys).agg(*measures)


def conflicting_duplicates(df: DataFrame, build: str = "tr_build_id") -> DataFrame:
    """Rows of builds whose rows are not all equal.

    Smallest and largest row differ exactly when two rows do, and both fold
    on the map side; no build's rows are gathered.
    """
    rest = F.struct(*[c for c in df.columns if c != build])
    conflicting = (
        df.groupBy(build).agg(F.min(rest).alias("_lo"), F.max(rest).alias("_hi"))
        .filter(~F.col("_lo").eqNullSafe(F.col("_hi")))
        .select(build)
    )
    return df.join(conflicting, build, "left_semi")


def null_ratio(df: DataFrame) -> DataFrame:
    shares = df.agg(*[F.avg(_is_null(c)).alias(c) for c in df.columns])
    return (
        _long(shares, df.columns, "column", "null_ratio")
        .filter(F.col("null_ratio") > 0)
        .orderBy(F.desc("null_ratio"), "column")
    )


def null_columns(df: DataFrame) -> DataFrame:
    present = df.agg(*[F.max(_is_null(c)).alias(c) for c in df.columns])
    return _long(present, df.columns, "column", "has_null").filter("has_null = 1").select("column")


def nulls_per_row_histogram(df: DataFrame) -> DataFrame:
    nulls = sum((_is_null(c) for c in df.columns), F.lit(0))
    counts = df.groupBy(nulls.alias("nan_columns")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    share = C.percent(F.col("rows"), C.only_row(total)["total"])
    return counts.select("nan_columns", "rows", share.alias("ratio_pct")).orderBy("nan_columns")


def class_distribution(df: DataFrame, keys: Iterable[str], label: str = LABEL) -> DataFrame:
    """Share of each class per key; a class that is absent has share 0."""
    y = F.col(label).cast("double")
    return df.groupBy(*keys).agg(
        F.count(y).alias("rows"),
        F.avg(1 - y).alias("passed_ratio"),
        F.avg(y).alias("failed_ratio"),
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are known, null when one is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(varies, r)


def label_correlation(
    df: DataFrame, features: Iterable[str], label: str = LABEL
) -> DataFrame:
    features = list(features)
    wide = df.agg(*[correlation(F.col(c), F.col(label)).alias(c) for c in features])
    return _long(wide, features, "feature", "correlation").orderBy("correlation", "feature")


def class_weights(df: DataFrame, keys: Iterable[str] = (), label: str = LABEL) -> DataFrame:
    """Balanced weights n / (2 n_c), null for an absent class."""
    n = F.count(F.col(label))
    return df.groupBy(*keys).agg(
        F.try_divide(n, 2 * F.count_if(F.col(label) == 0)).alias("weight_0"),
        F.try_divide(n, 2 * F.count_if(F.col(label) == 1)).alias("weight_1"),
    )


# -- metric entries -----------------------------------------------------------
def _means(metrics: Iterable[str], names: Mapping[str, str] | None = None) -> list[Column]:
    return [F.avg(m).alias((names or {}).get(m, m)) for m in metrics]


def metric_rollup(entries: DataFrame, metrics: Iterable[str] = ENTRY_METRICS) -> DataFrame:
    """Mean per fold, mean of folds per project, flat project mean, and the
    mean and sample deviation across projects, told apart by ``level``.

    A mean of fold means is not the flat mean, so this is not a ROLLUP.
    Entries are one row per fitted model; the fold table is shared.
    """
    metrics = list(metrics)
    none = {m: F.lit(None).cast("double") for m in metrics}
    fold = entries.groupBy("proj", "exp").agg(*_means(metrics))
    dataset = fold.groupBy("proj").agg(*_means(metrics))
    project = entries.groupBy("proj").agg(*_means(metrics))
    pipeline = project.agg(
        *_means(metrics), *[F.stddev_samp(m).alias(f"std_{m}") for m in metrics])

    def level(df: DataFrame, name: str) -> DataFrame:
        have = set(df.columns)
        return df.select(
            F.lit(name).alias("level"),
            (F.col("proj") if "proj" in have else F.lit(None).cast("string")).alias("proj"),
            (F.col("exp") if "exp" in have else F.lit(None).cast("int")).alias("exp"),
            *metrics,
            *[(F.col(f"std_{m}") if f"std_{m}" in have else none[m]).alias(f"std_{m}")
              for m in metrics],
        )

    parts = [level(fold, "fold"), level(dataset, "dataset"), level(project, "project"),
             level(pipeline, "pipeline")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def metrics_by_project_exp(entries: DataFrame) -> DataFrame:
    keys = {"proj", "exp", "iter"}
    metrics = [f.name for f in entries.schema
               if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    return entries.groupBy("proj", "exp").agg(*_means(metrics))


def metric_box_stats(
    entries: DataFrame, metrics: Iterable[str] = ("AUC", "accuracy", "F1")
) -> DataFrame:
    """Five-number summary of each metric per project."""
    names = ["low", "q1", "median", "q3", "high"]
    long = entries.unpivot(["proj"], list(metrics), "metric", "value")
    return exact_quantiles(long, ["proj", "metric"], "value", [0, 0.25, 0.5, 0.75, 1], names)


def phase_summary(entries: DataFrame, phase: str = "phase") -> DataFrame:
    """Mean and sample deviation of the metrics per validation phase, and overall."""
    def stats(df):
        return df.agg(
            F.count(F.lit(1)).alias("entries"),
            *[F.avg(m).alias(f"avg_{m}") for m in ENTRY_METRICS],
            *[F.stddev_samp(m).alias(f"std_{m}") for m in ENTRY_METRICS],
        )

    per_phase = stats(entries.groupBy(F.col(phase).alias("phase")))
    overall = stats(entries.groupBy()).withColumn("phase", F.lit("overall"))
    return per_phase.unionByName(overall)


# -- plain row sets -----------------------------------------------------------
def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def union_all_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def sort_project_time(df: DataFrame) -> DataFrame:
    """Total order by project and time (a range exchange, not one task)."""
    return df.orderBy(PROJECT, *TIME_ORDER)
