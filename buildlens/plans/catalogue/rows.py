"""Row-wise queries: labels, cleaning, calendar and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import columns as C
from ...operators import prepare as P
from ...schema import LABEL
from .. import fixtures as X
from .registry import query, r6, with_views


def _builds(select: str) -> str:
    return with_views(select, b=X.BUILDS_SQL)


_LABEL_SQL = "CASE WHEN tr_status = 'passed' THEN 0 WHEN tr_status IN ('failed', 'errored') THEN 1 END"


@query("status_to_label", _builds(
    f"SELECT tr_build_id, {_LABEL_SQL} AS build_failed FROM b WHERE {_LABEL_SQL} IS NOT NULL"))
def status_to_label(spark, sf_dir):
    return P.status_to_label(X.builds(spark, sf_dir)).select("tr_build_id", LABEL)


@query("filter_status", _builds(f"""
    SELECT tr_build_id, tr_status, {_LABEL_SQL} AS build_failed FROM b
    WHERE tr_status IN ('failed', 'errored', 'passed')"""))
def filter_status(spark, sf_dir):
    return P.filter_status(X.builds(spark, sf_dir)).select("tr_build_id", "tr_status", LABEL)


@query("normalise_bool_text", _builds("""
    SELECT tr_build_id, CAST(CASE WHEN gh_by_core_team_member IN ('True', '1.0') THEN 1
        WHEN gh_by_core_team_member IN ('False', '0.0') THEN 0 END AS DOUBLE)
        AS gh_by_core_team_member FROM b"""))
def normalise_bool_text(spark, sf_dir):
    return P.normalise_bool_text(X.builds(spark, sf_dir)).select(
        "tr_build_id", "gh_by_core_team_member")


_NUMERIC = [
    "tr_duration", "gh_team_size", "gh_sloc", "git_diff_src_churn", "gh_diff_files_added",
    "gh_diff_files_deleted", "gh_diff_files_modified", "gh_diff_doc_files",
    "gh_test_lines_per_kloc",
]


@query("select_numeric_features", _builds(f"""
    SELECT tr_build_id, tr_job_id, {", ".join(f"round({c}, 6) AS {c}" for c in _NUMERIC)},
        {_LABEL_SQL} AS build_failed FROM b WHERE {_LABEL_SQL} IS NOT NULL"""))
def select_numeric_features(spark, sf_dir):
    labelled = P.status_to_label(X.builds(spark, sf_dir))
    chosen, _, _ = P.select_numeric_features(labelled)
    return chosen.select(*[r6(c) if c in _NUMERIC else c for c in chosen.columns])


@query("coerce_numeric", _builds("""
    SELECT tr_build_id, CAST(tr_log_num_tests_failed AS DOUBLE) AS tr_log_num_tests_failed,
        row_number() OVER (PARTITION BY gh_project_name
            ORDER BY gh_build_started_at, tr_build_id, tr_job_id) - 1 AS x
    FROM b WHERE tr_log_num_tests_failed <> 'n/a'"""))
def coerce_numeric(spark, sf_dir):
    df = P.coerce_numeric(X.builds(spark, sf_dir), "tr_log_num_tests_failed")
    return df.select("tr_build_id", "tr_log_num_tests_failed", "x")


@query("coerce_numeric_filled", _builds("""
    SELECT tr_build_id, coalesce(TRY_CAST(tr_log_num_tests_failed AS DOUBLE), 0)
        AS tr_log_num_tests_failed,
        row_number() OVER (PARTITION BY gh_project_name
            ORDER BY gh_build_started_at, tr_build_id, tr_job_id) - 1 AS x FROM b"""))
def coerce_numeric_filled(spark, sf_dir):
    df = P.coerce_numeric(X.builds(spark, sf_dir), "tr_log_num_tests_failed", dropna=False)
    return df.select("tr_build_id", "tr_log_num_tests_failed", "x")


@query("num_files_edited", _builds("""
    SELECT tr_build_id, coalesce(gh_diff_files_added, 0) + coalesce(gh_diff_files_deleted, 0)
        + coalesce(gh_diff_files_modified, 0) AS num_files_edited FROM b"""))
def num_files_edited(spark, sf_dir):
    return P.num_files_edited(X.builds(spark, sf_dir)).select("tr_build_id", "num_files_edited")


@query("no_config_edited", _builds("""
    SELECT tr_build_id, CASE WHEN gh_diff_doc_files > 0 THEN 1 ELSE 0 END AS no_config_edited
    FROM b"""))
def no_config_edited(spark, sf_dir):
    return P.no_config_edited(X.builds(spark, sf_dir)).select("tr_build_id", "no_config_edited")


@query("to_labels", with_views(
    "SELECT proj, exp, iter, y, p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS label FROM s",
    s=X.SCORES_SQL))
def to_labels(spark, sf_dir):
    return X.scores(spark, sf_dir).withColumn("label", C.to_label(F.col("p"), 0.5))


# -- scalar functions ---------------------------------------------------------
@query("calendar_parts", _builds("""
    SELECT tr_build_id, CAST(year(gh_build_started_at) AS INT) AS year_of_start,
        CAST(month(gh_build_started_at) AS INT) AS month_of_start,
        CAST(day(gh_build_started_at) AS INT) AS day_of_start,
        CAST(hour(gh_build_started_at) AS INT) AS hour_of_start FROM b"""))
def calendar_parts(spark, sf_dir):
    parts = C.calendar_parts(F.col("gh_build_started_at"))
    return X.builds(spark, sf_dir).select(
        "tr_build_id", *[v.alias(n) for n, v in parts.items()])


@query("day_week", _builds(
    "SELECT tr_build_id, CAST(isodow(gh_build_started_at) - 1 AS INT) AS day_week FROM b"))
def day_week(spark, sf_dir):
    return X.builds(spark, sf_dir).select(
        "tr_build_id", C.day_week(F.col("gh_build_started_at")).alias("day_week"))


@query("safe_name", _builds("""
    SELECT tr_build_id, replace(replace(gh_project_name, '/', '_'), '\\', '_') AS safe_name
    FROM b"""))
def safe_name(spark, sf_dir):
    return X.builds(spark, sf_dir).select(
        "tr_build_id", C.safe_name(F.col("gh_project_name")).alias("safe_name"))


@query("parse_timestamp", with_views("""
    SELECT event_id, epoch_us(TRY_CAST(text AS TIMESTAMP)) AS started_us FROM t""",
    t="""SELECT event_id, CASE WHEN event_id % 12 = 0 THEN 'not a time'
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS text FROM events"""))
def parse_timestamp(spark, sf_dir):
    text = F.when(F.col("event_id") % 12 == 0, F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = C.parse_timestamp(text)
    return X.table(spark, sf_dir, "events").select(
        "event_id", F.unix_micros(parsed).alias("started_us"))


@query("round_pct", _builds("""
    SELECT gh_project_name, round_even(count(tr_duration) * 100.0::DOUBLE / count(*), 2)
            AS with_duration_pct,
        round_even(avg(CASE WHEN tr_duration IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4)
            AS missing_ratio
    FROM b GROUP BY gh_project_name"""))
def round_pct(spark, sf_dir):
    missing = F.col("tr_duration").isNull().cast("double")
    return X.builds(spark, sf_dir).groupBy("gh_project_name").agg(
        C.percent(F.count("tr_duration"), F.count(F.lit(1))).alias("with_duration_pct"),
        C.ratio4(F.avg(missing)).alias("missing_ratio"),
    )
