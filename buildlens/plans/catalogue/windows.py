"""Ordered history, encoding and imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import history as H
from ...operators import prepare as P
from ...schema import LABEL, MEAN_FILLED, PROJECT, ZERO_FILLED
from .. import fixtures as X
from ..flows import build_table as build_features_flow
from .registry import query, r6, with_views

ORDER = "gh_build_started_at, tr_build_id, tr_job_id"


def _on_builds(select: str) -> str:
    return with_views(select, b=X.LABELLED_SQL)


@query("elapsed_days_last_build", _on_builds(f"""
    SELECT tr_build_id, round(coalesce((epoch_us(gh_build_started_at)
        - lag(epoch_us(gh_build_started_at)) OVER (PARTITION BY gh_project_name ORDER BY {ORDER}))
        / 86400000000.0, 0), 6) AS elapsed_days_last_build FROM b"""))
def elapsed_days_last_build(spark, sf_dir):
    df = H.elapsed_days_last_build(X.labelled(spark, sf_dir))
    return df.select("tr_build_id", r6("elapsed_days_last_build"))


@query("same_committer", _on_builds(f"""
    SELECT tr_build_id, CASE WHEN gh_by_core_team_member = lag(gh_by_core_team_member)
        OVER (PARTITION BY gh_project_name ORDER BY {ORDER}) THEN 1 ELSE 0 END AS same_committer
    FROM b"""))
def same_committer(spark, sf_dir):
    return H.same_committer(X.labelled(spark, sf_dir)).select("tr_build_id", "same_committer")


def _rate_sql(name: str, keys: str, order: str, frame: str) -> str:
    return _on_builds(f"""
        SELECT tr_build_id, CASE WHEN {keys} IS NOT NULL THEN round(avg(build_failed)
            OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {frame} AND CURRENT ROW), 6)
            END AS {name} FROM b""")


@query("proj_fail_rate_history", _rate_sql(
    "proj_fail_rate_history", PROJECT, ORDER, "UNBOUNDED PRECEDING"))
def proj_fail_rate_history(spark, sf_dir):
    df = H.proj_fail_rate_history(X.labelled(spark, sf_dir))
    return df.select("tr_build_id", r6("proj_fail_rate_history"))


@query("proj_fail_rate_recent", _rate_sql("proj_fail_rate_recent", PROJECT, ORDER, "9 PRECEDING"))
def proj_fail_rate_recent(spark, sf_dir):
    df = H.proj_fail_rate_recent(X.labelled(spark, sf_dir))
    return df.select("tr_build_id", r6("proj_fail_rate_recent"))


@query("comm_fail_rate_history", _rate_sql(
    "comm_fail_rate_history", "gh_by_core_team_member", f"gh_project_name, {ORDER}",
    "UNBOUNDED PRECEDING"))
def comm_fail_rate_history(spark, sf_dir):
    df = H.comm_fail_rate_history(X.labelled(spark, sf_dir))
    return df.select("tr_build_id", r6("comm_fail_rate_history"))


@query("comm_fail_rate_recent", _rate_sql(
    "comm_fail_rate_recent", "gh_by_core_team_member", f"gh_project_name, {ORDER}", "9 PRECEDING"))
def comm_fail_rate_recent(spark, sf_dir):
    df = H.comm_fail_rate_recent(X.labelled(spark, sf_dir))
    return df.select("tr_build_id", r6("comm_fail_rate_recent"))


@query("comm_avg_experience", _on_builds(f"""
    SELECT tr_build_id, CASE WHEN gh_by_core_team_member IS NOT NULL THEN row_number()
        OVER (PARTITION BY gh_by_core_team_member ORDER BY gh_project_name, {ORDER})
        END AS comm_avg_experience FROM b"""))
def comm_avg_experience(spark, sf_dir):
    df = H.comm_avg_experience(X.labelled(spark, sf_dir))
    return df.select("tr_build_id", "comm_avg_experience")


@query("num_distinct_authors", with_views("""
    SELECT j.tr_build_id, j.tr_job_id, a.num_distinct_authors FROM j JOIN (
        SELECT tr_build_id, count(DISTINCT gh_by_core_team_member) AS num_distinct_authors
        FROM j GROUP BY tr_build_id) a ON j.tr_build_id = a.tr_build_id""", j=X.JOBS_SQL))
def num_distinct_authors(spark, sf_dir):
    df = H.num_distinct_authors(X.jobs(spark, sf_dir))
    return df.select("tr_build_id", "tr_job_id", "num_distinct_authors")


@query("prev_build_result", _on_builds(f"""
    SELECT tr_build_id, CAST(coalesce(lag(build_failed)
        OVER (PARTITION BY gh_project_name ORDER BY {ORDER}), 0) AS DOUBLE) AS prev_build_result
    FROM b"""))
def prev_build_result(spark, sf_dir):
    return H.prev_build_result(X.labelled(spark, sf_dir)).select(
        "tr_build_id", "prev_build_result")


# -- imputation ---------------------------------------------------------------
_ZERO = [c for c in ZERO_FILLED if c in dict(X.LABELLED) and c != "tr_log_num_tests_failed"]


@query("impute_zero", _on_builds(
    "SELECT tr_build_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _ZERO) + " FROM b"))
def impute_zero(spark, sf_dir):
    df = P.impute_zero(X.labelled(spark, sf_dir), _ZERO)
    return df.select("tr_build_id", *_ZERO)


_MEAN = [c for c in MEAN_FILLED if c in dict(X.LABELLED)]


@query("impute_mean", _on_builds("SELECT tr_build_id, " + ", ".join(
    f"round(coalesce({c}, avg({c}) OVER (PARTITION BY gh_project_name), 0), 6) AS {c}"
    for c in _MEAN) + " FROM b"))
def impute_mean(spark, sf_dir):
    df = P.impute_mean(X.labelled(spark, sf_dir))
    return df.select("tr_build_id", *[r6(c) for c in _MEAN])


@query("impute_mode", _on_builds("""
    , m AS (SELECT gh_project_name, gh_by_core_team_member AS v, row_number() OVER (
        PARTITION BY gh_project_name ORDER BY count(*) DESC, gh_by_core_team_member) AS r
        FROM b WHERE gh_by_core_team_member IS NOT NULL GROUP BY 1, 2)
    SELECT tr_build_id, coalesce(gh_by_core_team_member, m.v, 0) AS gh_by_core_team_member
    FROM b LEFT JOIN m ON b.gh_project_name = m.gh_project_name AND r = 1"""))
def impute_mode(spark, sf_dir):
    df = P.impute_mode(X.labelled(spark, sf_dir))
    return df.select("tr_build_id", "gh_by_core_team_member")


@query("impute_median", _on_builds("""
    SELECT tr_build_id,
        round(coalesce(gh_team_size, median(gh_team_size) OVER (PARTITION BY gh_project_name), 1),
            6) AS gh_team_size,
        round(coalesce(gh_sloc, median(gh_sloc) OVER (PARTITION BY gh_project_name), 0), 6)
            AS gh_sloc FROM b"""))
def impute_median(spark, sf_dir):
    df = P.impute_median(X.labelled(spark, sf_dir))
    return df.select("tr_build_id", r6("gh_team_size"), r6("gh_sloc"))


_INTERPOLATED = """
    , n AS (SELECT *, row_number() OVER (PARTITION BY gh_project_name ORDER BY {o}) AS i FROM b)
    , s AS (SELECT *,
        last_value(CASE WHEN tr_duration IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi,
        last_value(tr_duration IGNORE NULLS) OVER p AS pv,
        last_value(CASE WHEN tr_duration IS NOT NULL THEN i END IGNORE NULLS) OVER q AS qi,
        last_value(tr_duration IGNORE NULLS) OVER q AS qv
        FROM n WINDOW p AS (PARTITION BY gh_project_name ORDER BY i
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            q AS (PARTITION BY gh_project_name ORDER BY i DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT tr_build_id, round(coalesce(tr_duration,
        CASE WHEN pi IS NOT NULL AND qi IS NOT NULL
            THEN pv + (qv - pv) / (qi - pi) * (i - pi) END, pv, qv, 0), 6) AS tr_duration
    FROM s"""


@query("impute_interpolate", _on_builds(_INTERPOLATED.format(o=ORDER)))
def impute_interpolate(spark, sf_dir):
    df = P.impute_interpolate(X.labelled(spark, sf_dir))
    return df.select("tr_build_id", r6("tr_duration"))


_IMPUTED = _INTERPOLATED.format(o=ORDER).split("SELECT tr_build_id")[0]


@query("impute_all", _on_builds(_IMPUTED + """
    , m AS (SELECT gh_project_name AS g, gh_by_core_team_member AS v, row_number() OVER (
        PARTITION BY gh_project_name ORDER BY count(*) DESC, gh_by_core_team_member) AS r
        FROM b WHERE gh_by_core_team_member IS NOT NULL GROUP BY 1, 2)
    SELECT tr_build_id, round(coalesce(tr_duration,
            CASE WHEN pi IS NOT NULL AND qi IS NOT NULL
                THEN pv + (qv - pv) / (qi - pi) * (i - pi) END, pv, qv, 0), 6) AS tr_duration,
        coalesce(gh_by_core_team_member, m.v, 0) AS gh_by_core_team_member,
        round(coalesce(gh_test_lines_per_kloc, avg(gh_test_lines_per_kloc) OVER w, 0), 6)
            AS gh_test_lines_per_kloc,
        round(coalesce(gh_team_size, median(gh_team_size) OVER w, 1), 6) AS gh_team_size,
        round(coalesce(gh_sloc, median(gh_sloc) OVER w, 0), 6) AS gh_sloc,
        coalesce(git_diff_src_churn, 0) AS git_diff_src_churn,
        coalesce(gh_diff_files_modified, 0) AS gh_diff_files_modified
    FROM s LEFT JOIN m ON s.gh_project_name = m.g AND r = 1
    WINDOW w AS (PARTITION BY gh_project_name)"""))
def impute_all(spark, sf_dir):
    """Every imputation rule at once."""
    df = P.impute(X.labelled(spark, sf_dir).drop("tr_log_num_tests_failed"))
    return df.select(
        "tr_build_id", r6("tr_duration"), "gh_by_core_team_member",
        r6("gh_test_lines_per_kloc"), r6("gh_team_size"), r6("gh_sloc"), "git_diff_src_churn",
        "gh_diff_files_modified")


@query("build_features", _on_builds(f"""
    , base AS (SELECT * FROM b WHERE build_failed IS NOT NULL)
    SELECT tr_build_id,
        CAST(year(gh_build_started_at) AS INT) AS year_of_start,
        CAST(month(gh_build_started_at) AS INT) AS month_of_start,
        CAST(day(gh_build_started_at) AS INT) AS day_of_start,
        CAST(hour(gh_build_started_at) AS INT) AS hour_of_start,
        CAST(isodow(gh_build_started_at) - 1 AS INT) AS day_week,
        round(coalesce((epoch_us(gh_build_started_at) - lag(epoch_us(gh_build_started_at))
            OVER p) / 86400000000.0, 0), 6) AS elapsed_days_last_build,
        CASE WHEN gh_by_core_team_member = lag(gh_by_core_team_member) OVER p
            THEN 1 ELSE 0 END AS same_committer,
        CAST(coalesce(lag(build_failed) OVER p, 0) AS DOUBLE) AS prev_build_result,
        round(avg(build_failed) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
            AS proj_fail_rate_history,
        round(avg(build_failed) OVER (p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6)
            AS proj_fail_rate_recent,
        CASE WHEN gh_by_core_team_member IS NOT NULL THEN round(avg(build_failed)
            OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) END
            AS comm_fail_rate_history,
        CASE WHEN gh_by_core_team_member IS NOT NULL THEN round(avg(build_failed)
            OVER (c ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) END AS comm_fail_rate_recent,
        CASE WHEN gh_by_core_team_member IS NOT NULL THEN row_number() OVER c END
            AS comm_avg_experience,
        CASE WHEN gh_by_core_team_member IS NULL THEN 0 ELSE 1 END AS num_distinct_authors,
        coalesce(gh_diff_files_added, 0) + coalesce(gh_diff_files_deleted, 0)
            + coalesce(gh_diff_files_modified, 0) AS num_files_edited,
        CASE WHEN gh_diff_doc_files > 0 THEN 1 ELSE 0 END AS no_config_edited
    FROM base WINDOW p AS (PARTITION BY gh_project_name ORDER BY {ORDER}),
        c AS (PARTITION BY gh_by_core_team_member ORDER BY gh_project_name, {ORDER})"""))
def build_features(spark, sf_dir):
    rows = X.labelled(spark, sf_dir).filter(F.col(LABEL).isNotNull())
    df = H.add_build_features(rows)
    rates = ["elapsed_days_last_build", "proj_fail_rate_history", "proj_fail_rate_recent",
             "comm_fail_rate_history", "comm_fail_rate_recent"]
    plain = ["tr_build_id", "year_of_start", "month_of_start", "day_of_start", "hour_of_start",
             "day_week", "same_committer", "prev_build_result", "comm_avg_experience",
             "num_distinct_authors", "num_files_edited", "no_config_edited"]
    return df.select(*plain, *[r6(c) for c in rates])


_SCALED_COLUMNS = ["tr_duration", "proj_fail_rate_recent", "elapsed_days_last_build"]


@query("build_table", with_views(f"""
    , s AS (SELECT *, last_value(CASE WHEN tr_duration IS NOT NULL THEN i END IGNORE NULLS) OVER p
            AS pi, last_value(tr_duration IGNORE NULLS) OVER p AS pv,
        last_value(CASE WHEN tr_duration IS NOT NULL THEN i END IGNORE NULLS) OVER q AS qi,
        last_value(tr_duration IGNORE NULLS) OVER q AS qv FROM n
        WINDOW p AS (PARTITION BY gh_project_name ORDER BY i
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            q AS (PARTITION BY gh_project_name ORDER BY i DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    f AS (SELECT tr_build_id, gh_project_name, build_failed,
        coalesce(tr_duration, CASE WHEN pi IS NOT NULL AND qi IS NOT NULL
            THEN pv + (qv - pv) / (qi - pi) * (i - pi) END, pv, qv, 0) AS tr_duration,
        avg(build_failed) OVER (PARTITION BY gh_project_name ORDER BY i
            ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS proj_fail_rate_recent,
        coalesce((epoch_us(gh_build_started_at) - lag(epoch_us(gh_build_started_at))
            OVER (PARTITION BY gh_project_name ORDER BY i)) / 86400000000.0, 0)
            AS elapsed_days_last_build FROM s)
    SELECT tr_build_id, gh_project_name, build_failed, """ + ", ".join(
        f"""round(({c} - min({c}) OVER g) / CASE WHEN max({c}) OVER g > min({c}) OVER g
            THEN max({c}) OVER g - min({c}) OVER g ELSE 1 END, 6) AS {c}"""
        for c in _SCALED_COLUMNS) + " FROM f WINDOW g AS (PARTITION BY gh_project_name)",
    b=X.LABELLED_SQL + " WHERE event_type <> 'signup'",
    k="""SELECT gh_project_name FROM b GROUP BY 1
        HAVING greatest(avg(build_failed), avg(1 - build_failed)) <= 0.7
        ORDER BY count(*) DESC, gh_project_name LIMIT 8""",
    n=f"""SELECT *, row_number() OVER (PARTITION BY gh_project_name ORDER BY {ORDER}) AS i
        FROM b WHERE gh_project_name IN (SELECT gh_project_name FROM k)"""))
def build_table(spark, sf_dir):
    """The whole preparation: select, impute, add features, merge jobs, scale."""
    df = build_features_flow(X.builds(spark, sf_dir), min_rows=10, balance=0.7, top=8)
    return df.select("tr_build_id", PROJECT, LABEL, *[r6(c) for c in _SCALED_COLUMNS])
