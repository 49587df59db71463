"""Profiling, aggregation, encoding and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import encode as N
from ...operators import prepare as P
from ...operators import profile as A
from ...operators import rank as R
from ...schema import LABEL, PROJECT
from .. import fixtures as X
from .registry import query, r6, with_views

_COLUMNS = [n for n, _ in X.LABELLED]
_MEASURES = [c for c in _COLUMNS if c not in (PROJECT, "gh_build_started_at", LABEL, "gh_is_pr")]


def _on_builds(select: str) -> str:
    return with_views(select, b=X.LABELLED_SQL)


def _on_jobs(select: str) -> str:
    return with_views(select, j=X.JOBS_SQL)


_NULLS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in _COLUMNS)


@query("project_summary", _on_builds(f"""
    , g AS (SELECT gh_project_name AS project, count(*) AS num_rows, sum({_NULLS}) AS nulls,
        count(build_failed) AS labels, sum(build_failed) AS failed FROM b GROUP BY 1)
    SELECT project, num_rows,
        round_even(CAST(nulls AS DOUBLE) / (num_rows * {len(_COLUMNS)}), 4) AS missing_ratio,
        round_even(CAST(labels - failed AS DOUBLE) / labels, 4) AS passed_ratio,
        round_even(CAST(failed AS DOUBLE) / labels, 4) AS failed_ratio
    FROM g WHERE num_rows >= 100 AND labels > 0
        AND greatest(CAST(failed AS DOUBLE) / labels, CAST(labels - failed AS DOUBLE) / labels)
            <= 0.7"""))
def project_summary(spark, sf_dir):
    return A.project_summary(X.labelled(spark, sf_dir), min_rows=100, balance=0.7)


@query("jobs_to_builds", _on_jobs("""
    SELECT gh_project_name, epoch_us(gh_build_started_at) AS started_us, build_failed, tr_build_id,
        sum(git_diff_src_churn) AS git_diff_src_churn,
        coalesce(sum(git_diff_test_churn), 0) AS git_diff_test_churn,
        coalesce(sum(gh_diff_src_files), 0) AS gh_diff_src_files,
        round(avg(gh_test_cases_per_kloc), 6) AS gh_test_cases_per_kloc,
        round(avg(gh_team_size), 6) AS gh_team_size,
        max(gh_by_core_team_member) AS gh_by_core_team_member,
        max(tr_duration) AS tr_duration, bool_or(gh_is_pr) AS gh_is_pr,
        min(day_week) AS day_week
    FROM j GROUP BY 1, 2, 3, 4"""))
def jobs_to_builds(spark, sf_dir):
    df = A.jobs_to_builds(X.jobs(spark, sf_dir))
    return df.select(
        PROJECT, F.unix_micros("gh_build_started_at").alias("started_us"), LABEL, "tr_build_id",
        "git_diff_src_churn", "git_diff_test_churn", "gh_diff_src_files",
        r6("gh_test_cases_per_kloc"), r6("gh_team_size"), "gh_by_core_team_member",
        "tr_duration", "gh_is_pr", "day_week")


@query("conflicting_duplicates", _on_jobs("""
    SELECT tr_build_id, tr_job_id, git_diff_src_churn, tr_duration FROM j
    WHERE tr_build_id IN (SELECT tr_build_id FROM (SELECT DISTINCT tr_build_id, tr_job_id,
        gh_project_name, gh_build_started_at, build_failed, git_diff_src_churn,
        tr_duration FROM j) GROUP BY tr_build_id HAVING count(*) > 1)"""))
def conflicting_duplicates(spark, sf_dir):
    df = X.jobs(spark, sf_dir).select(
        "tr_build_id", "tr_job_id", PROJECT, "gh_build_started_at", LABEL,
        "git_diff_src_churn", "tr_duration")
    return A.conflicting_duplicates(df).select(
        "tr_build_id", "tr_job_id", "git_diff_src_churn", "tr_duration")


@query("null_ratio", _on_builds(" UNION ALL ".join(
    f"""{'SELECT * FROM (' if i == 0 else ''}SELECT '{c}' AS "column",
        round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS null_ratio FROM b"""
    for i, c in enumerate(_COLUMNS)) + ") WHERE null_ratio > 0"))
def null_ratio(spark, sf_dir):
    return A.null_ratio(X.labelled(spark, sf_dir)).select("column", r6("null_ratio"))


@query("null_columns", _on_builds(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column" FROM b WHERE {c} IS NULL GROUP BY 1""" for c in _COLUMNS)))
def null_columns(spark, sf_dir):
    return A.null_columns(X.labelled(spark, sf_dir))


@query("nulls_per_row_histogram", _on_builds(f"""
    SELECT CAST({_NULLS} AS INT) AS nan_columns, count(*) AS rows,
        round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS ratio_pct
    FROM b GROUP BY 1"""))
def nulls_per_row_histogram(spark, sf_dir):
    return A.nulls_per_row_histogram(X.labelled(spark, sf_dir))


@query("class_distribution", _on_builds("""
    SELECT gh_project_name, count(build_failed) AS rows,
        round(avg(1 - build_failed), 6) AS passed_ratio,
        round(avg(build_failed), 6) AS failed_ratio FROM b GROUP BY 1"""))
def class_distribution(spark, sf_dir):
    df = A.class_distribution(X.labelled(spark, sf_dir), [PROJECT])
    return df.select(PROJECT, "rows", r6("passed_ratio"), r6("failed_ratio"))


@query("label_correlation", _on_builds(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CASE WHEN min(x) < max(x) THEN round(corr(x, y), 6) END
        AS correlation FROM (SELECT CAST({c} AS DOUBLE) AS x, CAST(build_failed AS DOUBLE) AS y
        FROM b WHERE {c} IS NOT NULL AND build_failed IS NOT NULL)"""
    for c in _MEASURES if c != "tr_log_num_tests_failed")))
def label_correlation(spark, sf_dir):
    names = [c for c in _MEASURES if c != "tr_log_num_tests_failed"]
    df = A.label_correlation(X.labelled(spark, sf_dir), names)
    return df.select("feature", r6("correlation"))


@query("class_weights", _on_builds("""
    SELECT gh_project_name,
        round(count(build_failed) / (2.0::DOUBLE * sum(1 - build_failed)), 6) AS weight_0,
        round(count(build_failed) / (2.0::DOUBLE * sum(build_failed)), 6) AS weight_1
    FROM b GROUP BY 1"""))
def class_weights(spark, sf_dir):
    df = A.class_weights(X.labelled(spark, sf_dir), [PROJECT])
    return df.select(PROJECT, r6("weight_0"), r6("weight_1"))


# -- projects -----------------------------------------------------------------
@query("select_projects", _on_builds("""
    SELECT tr_build_id, gh_project_name FROM b WHERE gh_project_name IN (
        SELECT gh_project_name FROM b GROUP BY 1
        HAVING greatest(avg(build_failed), avg(1 - build_failed)) <= 0.7
        ORDER BY count(*) DESC, gh_project_name LIMIT 4)"""))
def select_projects(spark, sf_dir):
    df = X.labelled(spark, sf_dir)
    summary = A.project_summary(df, min_rows=1, balance=0.7)
    return R.select_projects(df, summary, k=4).select("tr_build_id", PROJECT)


@query("top_datasets", _on_builds("""
    SELECT gh_project_name AS project, count(*) AS num_rows FROM b GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 5"""))
def top_datasets(spark, sf_dir):
    return R.top_datasets(X.labelled(spark, sf_dir), k=5)


@query("other_projects", _on_builds("""
    SELECT tr_build_id, gh_project_name FROM b WHERE gh_project_name <> (
        SELECT gh_project_name FROM b GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""))
def other_projects(spark, sf_dir):
    df = X.labelled(spark, sf_dir)
    first = R.top_datasets(df, k=1).select(F.col("project").alias(PROJECT))
    return R.other_projects(df, first).select("tr_build_id", PROJECT)


@query("except_project", _on_builds("""
    SELECT tr_build_id, gh_project_name FROM b WHERE gh_project_name <> 'org/proj3'"""))
def except_project(spark, sf_dir):
    return R.except_project(X.labelled(spark, sf_dir), "org/proj3").select("tr_build_id", PROJECT)


@query("sort_project_time", _on_builds("""
    SELECT tr_build_id, gh_project_name, row_number() OVER (ORDER BY gh_project_name,
        gh_build_started_at, tr_build_id, tr_job_id) AS place FROM b"""))
def sort_project_time(spark, sf_dir):
    ordered = A.sort_project_time(X.labelled(spark, sf_dir))
    return R.number_rows(ordered.select("tr_build_id", PROJECT, "gh_build_started_at", "tr_job_id"),
                         "place").select("tr_build_id", PROJECT, "place")


# -- sets ---------------------------------------------------------------------
@query("union_all_by_name", _on_builds("""
    SELECT tr_build_id, gh_project_name, tr_duration, NULL::DOUBLE AS gh_sloc FROM b
    WHERE gh_is_pr
    UNION ALL SELECT tr_build_id, gh_project_name, NULL, gh_sloc FROM b WHERE NOT gh_is_pr"""))
def union_all_by_name(spark, sf_dir):
    df = X.labelled(spark, sf_dir)
    pulls = df.filter("gh_is_pr").select("tr_build_id", PROJECT, "tr_duration")
    pushes = df.filter("NOT gh_is_pr").select("gh_sloc", PROJECT, "tr_build_id")
    return A.union_all_by_name(pulls, pushes)


@query("distinct_rows", _on_jobs("""
    SELECT DISTINCT tr_build_id, gh_project_name, gh_by_core_team_member, gh_is_pr FROM j"""))
def distinct_rows(spark, sf_dir):
    df = X.jobs(spark, sf_dir).select(
        "tr_build_id", PROJECT, "gh_by_core_team_member", "gh_is_pr")
    return A.distinct_rows(df)


# -- encoding -----------------------------------------------------------------
@query("label_encode", with_views("""
    SELECT tr_build_id, CAST(dense_rank() OVER (PARTITION BY gh_project_name
            ORDER BY coalesce(gh_by_core_team_member, 'nan')) - 1 AS INT) AS gh_by_core_team_member,
        CAST(dense_rank() OVER (PARTITION BY gh_project_name ORDER BY tr_status) - 1 AS INT)
            AS tr_status
    FROM b""", b=X.BUILDS_SQL))
def label_encode(spark, sf_dir):
    encoded, _ = N.label_encode(X.builds(spark, sf_dir), ["gh_by_core_team_member", "tr_status"])
    return encoded.select("tr_build_id", "gh_by_core_team_member", "tr_status")


@query("label_dictionary", with_views("""
    SELECT gh_project_name, 'gh_by_core_team_member' AS "column", v AS value,
        CAST(row_number() OVER (PARTITION BY gh_project_name ORDER BY v) - 1 AS INT) AS code
    FROM (SELECT DISTINCT gh_project_name, coalesce(gh_by_core_team_member, 'nan') AS v FROM b)""",
    b=X.BUILDS_SQL))
def label_dictionary(spark, sf_dir):
    return N.label_dictionary(X.builds(spark, sf_dir), ["gh_by_core_team_member"])


_SCALE = ["tr_duration", "gh_team_size", "gh_sloc", "gh_diff_files_added"]


@query("minmax_scale", _on_builds("SELECT tr_build_id, " + ", ".join(
    f"""round(({c} - min({c}) OVER p) / CASE WHEN max({c}) OVER p > min({c}) OVER p
        THEN max({c}) OVER p - min({c}) OVER p ELSE 1 END, 6) AS {c}""" for c in _SCALE)
    + " FROM b WINDOW p AS (PARTITION BY gh_project_name)"))
def minmax_scale(spark, sf_dir):
    scaled, _ = N.minmax_scale(X.labelled(spark, sf_dir), _SCALE)
    return scaled.select("tr_build_id", *[r6(c) for c in _SCALE])


@query("minmax_apply", _on_builds("""
    , t AS (SELECT gh_project_name, min(tr_duration) AS lo, max(tr_duration) AS hi FROM b
        WHERE build_failed = 0 GROUP BY 1)
    SELECT tr_build_id, round((tr_duration - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6)
        AS tr_duration FROM b JOIN t ON b.gh_project_name = t.gh_project_name
    WHERE build_failed = 1"""))
def minmax_apply(spark, sf_dir):
    """A scaler fitted on passed builds, applied to failed ones."""
    df = X.labelled(spark, sf_dir)
    scaler = N.minmax_table(df.filter(F.col(LABEL) == 0), ["tr_duration"])
    scaled = N.minmax_apply(df.filter(F.col(LABEL) == 1), scaler, ["tr_duration"])
    return scaled.select("tr_build_id", r6("tr_duration"))


@query("cyclical_encode", _on_builds("""
    SELECT tr_build_id,
        round(sin(2 * pi() * month(gh_build_started_at) / 12), 6) AS month_of_start_sin,
        round(cos(2 * pi() * month(gh_build_started_at) / 12), 6) AS month_of_start_cos,
        round(sin(2 * pi() * hour(gh_build_started_at) / 24), 6) AS hour_of_start_sin,
        round(cos(2 * pi() * hour(gh_build_started_at) / 24), 6) AS hour_of_start_cos,
        round(sin(2 * pi() * (isodow(gh_build_started_at) - 1) / 7), 6) AS day_week_sin,
        round(cos(2 * pi() * (isodow(gh_build_started_at) - 1) / 7), 6) AS day_week_cos
    FROM b"""))
def cyclical_encode(spark, sf_dir):
    from ...operators.history import calendar

    df = N.cyclical_encode(
        calendar(X.labelled(spark, sf_dir)), ["month_of_start", "hour_of_start", "day_week"])
    made = [c for c in df.columns if c.endswith(("_sin", "_cos"))]
    return df.select("tr_build_id", *[r6(c) for c in made])


_STANDARD = ["gh_diff_files_added", "git_diff_src_churn", "gh_sloc"]


@query("standard_scale", _on_builds("SELECT tr_build_id, build_failed, pr_flag, " + ", ".join(
    f"""round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}""" for c in _STANDARD)
    + """ FROM (SELECT *, CASE WHEN gh_is_pr THEN 1 ELSE 0 END AS pr_flag FROM b)"""
    + " WHERE build_failed IS NOT NULL"))
def standard_scale(spark, sf_dir):
    df = (X.labelled(spark, sf_dir).filter(F.col(LABEL).isNotNull())
          .withColumn("pr_flag", F.col("gh_is_pr").cast("int")))
    chosen = df.select("tr_build_id", *_STANDARD, "pr_flag", LABEL)
    scaled, _ = N.standard_scale(chosen, [*_STANDARD, "pr_flag", LABEL])
    return scaled.select("tr_build_id", LABEL, "pr_flag", *[r6(c) for c in _STANDARD])


@query("failing_now", _on_builds(f"""
    , base AS (SELECT * FROM b WHERE build_failed IS NOT NULL)
    , f AS (SELECT *, avg(build_failed) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS h, avg(build_failed) OVER (p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS r,
        row_number() OVER (PARTITION BY gh_project_name ORDER BY gh_build_started_at DESC,
            tr_build_id DESC, tr_job_id DESC) AS last
        FROM base WINDOW p AS (PARTITION BY gh_project_name
            ORDER BY gh_build_started_at, tr_build_id, tr_job_id))
    SELECT gh_project_name, tr_build_id, round(r, 6) AS proj_fail_rate_recent,
        round(h, 6) AS proj_fail_rate_history FROM f WHERE last = 1"""))
def failing_now(spark, sf_dir):
    """Recent against historical fail rate at the last build of every project."""
    from ...operators.history import by_project, project_history

    rows = X.labelled(spark, sf_dir).filter(F.col(LABEL).isNotNull()).select(
        PROJECT, "gh_build_started_at", "tr_build_id", "tr_job_id", LABEL,
        "gh_by_core_team_member")
    features = project_history(by_project(rows)).frame()
    latest = R.latest_row(features, [PROJECT], [
        "tr_build_id", "proj_fail_rate_recent", "proj_fail_rate_history"])
    return latest.select(
        PROJECT, "tr_build_id", r6("proj_fail_rate_recent"), r6("proj_fail_rate_history"))
