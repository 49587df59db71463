"""Top-k selections over projects, entries and features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PROJECT, TIME_ORDER
from .timeline import Timeline


def top_datasets(df: DataFrame, k: int = 10, project: str = PROJECT) -> DataFrame:
    """The k largest projects; ties by name."""
    sizes = df.filter(F.col(project).isNotNull()).groupBy(F.col(project).alias("project")).agg(
        F.count(F.lit(1)).alias("num_rows"))
    return sizes.orderBy(F.desc("num_rows"), "project").limit(k)


def select_projects(
    df: DataFrame, summary: DataFrame, k: int = 10, project: str = PROJECT
) -> DataFrame:
    """Rows of the k largest projects of a summary; k names are broadcast."""
    chosen = summary.orderBy(F.desc("num_rows"), "project").limit(k).select(
        F.col("project").alias(project))
    return df.join(F.broadcast(chosen), project, "left_semi")


def other_projects(df: DataFrame, chosen: DataFrame, project: str = PROJECT) -> DataFrame:
    """Rows of all projects but the chosen one (one row, broadcast)."""
    return df.join(F.broadcast(chosen.select(project).limit(1)), project, "left_anti")


def except_project(df: DataFrame, name: str, project: str = PROJECT) -> DataFrame:
    return df.filter(F.col(project) != name)


def latest_row(df: DataFrame, keys: list[str], columns: Iterable[str]) -> DataFrame:
    """Columns of the last row in time per key, folded on the map side."""
    packed = F.max_by(F.struct(*columns), F.struct(*TIME_ORDER)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*")


def number_rows(ordered: DataFrame, name: str) -> DataFrame:
    """1-based place of each row in (project, time) order over all projects.

    Places inside a project come from its timeline, the offset from the sizes
    of the projects that sort before it.
    """
    line = Timeline.of(ordered, [PROJECT], TIME_ORDER).position("_in")
    sizes = ordered.groupBy(PROJECT).agg(F.count(F.lit(1)).alias("_n"))
    offsets = (
        Timeline.of(sizes.withColumn("_all", F.lit(1)), ["_all"], [PROJECT])
        .running({"_before": F.col("_n")}, exclude_current=True)
        .frame()
        .select(PROJECT, F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    placed = line.frame().join(offsets, PROJECT)
    return placed.withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before")


# -- metric entries and importances -------------------------------------------
def bellwether(entries: DataFrame) -> DataFrame:
    """The project with the best mean F1; ties by name."""
    means = entries.groupBy("proj").agg(F.avg("F1").alias("F1"), F.avg("PR_AUC").alias("PR_AUC"))
    return means.orderBy(F.desc("F1"), "proj").limit(1)


def best_entry_per_project(entries: DataFrame) -> DataFrame:
    """The entry with the best F1 per project, the earliest fold and repeat on
    ties; a max over structs instead of a sorted window."""
    rank = F.struct("F1", -F.col("exp"), -F.col("iter"))
    best = entries.groupBy("proj").agg(
        F.max_by(F.struct(*[c for c in entries.columns if c != "proj"]), rank).alias("_e"))
    return best.select("proj", "_e.*")


def top_features(importance: DataFrame, n: int) -> DataFrame:
    return importance.orderBy(F.desc("Average_Importance"), "Feature").limit(n)


def top_candidates(candidates: DataFrame, n: int = 3) -> DataFrame:
    return candidates.orderBy(F.desc("score"), "candidate").limit(n)
