"""History features of every job row, in (project, time) order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import COMMITTER, LABEL, PROJECT, STARTED, TIME_ORDER
from .prepare import no_config_edited, num_files_edited
from .timeline import Timeline

RECENT = 10


def by_project(df: DataFrame, hot_rows: int | None = None) -> Timeline:
    return Timeline.of(df, [PROJECT], TIME_ORDER, hot_rows)


def by_committer(
    df: DataFrame, hot_rows: int | None = None, base: DataFrame | None = None
) -> Timeline:
    """Committer flags have two values, so this order is nearly always sliced."""
    return Timeline.of(df, [COMMITTER], [PROJECT, *TIME_ORDER], hot_rows, base)


def _rate(line: Timeline, name: str, exclude_current: bool) -> Timeline:
    label = F.col(LABEL).cast("double")
    line = line.running(
        {"_failed": label, "_known": label.isNotNull().cast("long")}, exclude_current
    )
    rate = F.try_divide(F.col("_failed"), F.col("_known"))
    return line.map(lambda rows: rows.withColumn(name, rate).drop("_failed", "_known"))


def _days_between(now: Column, then: Column) -> Column:
    micros = F.unix_micros(now) - F.unix_micros(then)
    return F.coalesce(micros / F.lit(86_400_000_000.0), F.lit(0.0))


def project_history(line: Timeline, exclude_current: bool = False) -> Timeline:
    """Days since the last build, same committer, previous result, fail rates."""
    at = F.col(STARTED).cast("timestamp")
    line = line.previous({"_at": at, "prev_committer": F.col(COMMITTER), "_y": F.col(LABEL)})
    line = _rate(line, "proj_fail_rate_history", exclude_current)
    line = line.recent_mean("proj_fail_rate_recent", F.col(LABEL), RECENT, exclude_current)
    same = F.coalesce(F.col(COMMITTER) == F.col("prev_committer"), F.lit(False))
    added = {
        "elapsed_days_last_build": _days_between(at, F.col("_at")),
        "same_committer": same.cast("int"),
        "prev_build_result": F.coalesce(F.col("_y").cast("double"), F.lit(0.0)),
    }
    return line.map(lambda rows: rows.withColumns(added).drop("_at", "_y"))


def committer_history(line: Timeline, exclude_current: bool = False) -> Timeline:
    """Fail rates and experience of the committer flag; null without a flag."""
    line = _rate(line, "comm_fail_rate_history", exclude_current)
    line = line.recent_mean("comm_fail_rate_recent", F.col(LABEL), RECENT, exclude_current)
    return line.position("comm_avg_experience")


# Single features, each with the least work it needs.
def elapsed_days_last_build(df: DataFrame) -> DataFrame:
    at = F.col(STARTED).cast("timestamp")
    rows = by_project(df).previous({"_at": at}).frame()
    return rows.withColumn("elapsed_days_last_build", _days_between(at, F.col("_at"))).drop("_at")


def same_committer(df: DataFrame) -> DataFrame:
    rows = by_project(df).previous({"prev_committer": F.col(COMMITTER)}).frame()
    same = F.coalesce(F.col(COMMITTER) == F.col("prev_committer"), F.lit(False))
    return rows.withColumn("same_committer", same.cast("int"))


def proj_fail_rate_history(df: DataFrame, exclude_current: bool = False) -> DataFrame:
    return _rate(by_project(df), "proj_fail_rate_history", exclude_current).frame()


def proj_fail_rate_recent(df: DataFrame, exclude_current: bool = False) -> DataFrame:
    line = by_project(df)
    return line.recent_mean(
        "proj_fail_rate_recent", F.col(LABEL), RECENT, exclude_current).frame()


def comm_fail_rate_history(df: DataFrame, exclude_current: bool = False) -> DataFrame:
    return _rate(by_committer(df), "comm_fail_rate_history", exclude_current).frame()


def comm_fail_rate_recent(df: DataFrame, exclude_current: bool = False) -> DataFrame:
    line = by_committer(df)
    return line.recent_mean(
        "comm_fail_rate_recent", F.col(LABEL), RECENT, exclude_current).frame()


def comm_avg_experience(df: DataFrame) -> DataFrame:
    return by_committer(df).position("comm_avg_experience").frame()


def num_distinct_authors(
    df: DataFrame, build: str = "tr_build_id", base: DataFrame | None = None
) -> DataFrame:
    """Distinct committer values per build id, on every row of the build."""
    per_build = (df if base is None else base).groupBy(build).agg(
        F.count_distinct(COMMITTER).alias("num_distinct_authors"))
    return df.join(per_build, build, "left")


def prev_build_result(df: DataFrame) -> DataFrame:
    rows = by_project(df).previous({"_y": F.col(LABEL)}).frame()
    return rows.withColumn(
        "prev_build_result", F.coalesce(F.col("_y").cast("double"), F.lit(0.0))).drop("_y")


def calendar(df: DataFrame) -> DataFrame:
    at = F.col(STARTED).cast("timestamp")
    return df.withColumns({**C.calendar_parts(at), "day_week": C.day_week(at)})


def add_build_features(df: DataFrame, exclude_current: bool = False) -> DataFrame:
    """Every history, calendar and change feature of a labelled job table."""
    rows = project_history(by_project(calendar(df)), exclude_current).frame()
    rows = committer_history(by_committer(rows, base=df), exclude_current).frame()
    rows = num_distinct_authors(rows, base=df)
    return num_files_edited(no_config_edited(rows))
