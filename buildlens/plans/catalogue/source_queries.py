"""File, run-log and queue queries. Their files are written from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import prepare as P
from ...schema import CANONICAL, LABEL, PROJECT, source_name
from ...session import scratch_folder
from ...sources import files, runlog
from ...streaming import jobs as J
from .. import fixtures as X
from . import evaluation as V
from .registry import query, r6, with_views

_COLUMNS = [n for n, _ in X.BUILDS]
_LABEL_SQL = "CASE WHEN tr_status = 'passed' THEN 0 WHEN tr_status IN ('failed', 'errored') THEN 1 END"


def _builds(select: str) -> str:
    return with_views(select, b=X.BUILDS_SQL)


def _canonical_rows(spark, sf_dir):
    df = X.builds(spark, sf_dir)
    return df.select(*[c for c in CANONICAL if c in df.columns])


_DIALECTS = ("push", "short", "job")


def _dialect_folder(spark, sf_dir) -> str:
    """Builds as CSV in the three header dialects, an empty file among them."""
    folder = scratch_folder(spark, "dialects")
    rows = _canonical_rows(spark, sf_dir)
    for i, dialect in enumerate(_DIALECTS):
        part = rows.filter(F.col("tr_build_id") % 3 == i).repartition(2)
        files.write_dialect(part, dialect, f"{folder}/{dialect}")
    rows.limit(0).select("tr_status").coalesce(1).write.mode("overwrite").csv(f"{folder}/empty")
    return folder


def _project_folder(spark, sf_dir):
    """(folder of per-project CSV files, project paths)."""
    folder = scratch_folder(spark, "projects")
    labelled = P.status_to_label(X.builds(spark, sf_dir))
    return folder, files.save_projects(labelled, folder)


_FLOATS = ["tr_duration", "gh_sloc", "gh_test_lines_per_kloc"]
_READ_BACK = """tr_build_id, gh_project_name, tr_status, epoch_us(gh_build_started_at) AS started_us,
    gh_is_pr, gh_by_core_team_member, TRY_CAST(tr_log_num_tests_failed AS DOUBLE)
        AS tr_log_num_tests_failed, round(tr_duration, 6) AS tr_duration,
    round(gh_sloc, 6) AS gh_sloc, round(gh_test_lines_per_kloc, 6) AS gh_test_lines_per_kloc"""


def _read_back(df):
    return df.select(
        "tr_build_id", PROJECT, "tr_status",
        F.unix_micros("gh_build_started_at").alias("started_us"), "gh_is_pr",
        "gh_by_core_team_member", "tr_log_num_tests_failed", *[r6(c) for c in _FLOATS])


@query("scan_typed_csv", _builds(f"SELECT {_READ_BACK} FROM b"))
def scan_typed_csv(spark, sf_dir):
    folder = scratch_folder(spark, "typed")
    files.write_dialect(_canonical_rows(spark, sf_dir), "job", folder)
    # this dialect's own names are mapped back after the typed scan
    return _read_back(files.canonicalise(files.scan_typed_csv(spark, folder), "job"))


@query("canonicalise", _builds(f"SELECT {_READ_BACK} FROM b"))
def canonicalise(spark, sf_dir):
    """Every dialect read by itself and brought to the same columns."""
    folder = _dialect_folder(spark, sf_dir)
    parts = [_read_back(files.canonicalise(
        files.scan_typed_csv(spark, f"{folder}/{dialect}"), dialect)) for dialect in _DIALECTS]
    return reduce(DataFrame.unionByName, parts)


@query("combine_sources", _builds(f"SELECT {_READ_BACK} FROM b"))
def combine_sources(spark, sf_dir):
    folder = _dialect_folder(spark, sf_dir)
    return _read_back(files.combine_sources(spark, folder, scratch_folder(spark, "combined")))


def _header(dialect: str) -> str:
    return ",".join(source_name(dialect, c) for c in CANONICAL if c in _COLUMNS)


@query("schema_groups", _builds(" UNION ALL ".join(
    f"SELECT DISTINCT '{_header(d)}' AS header, CAST(2 AS BIGINT) AS files, '{d}' AS folder "
    f"FROM b WHERE tr_build_id % 3 = {i}"
    for i, d in enumerate(_DIALECTS))))
def schema_groups(spark, sf_dir):
    groups = files.schema_groups(files.file_headers(spark, _dialect_folder(spark, sf_dir)))
    return groups.select("header", "files", "folder").distinct()


_LABELLED = f"SELECT *, {_LABEL_SQL} AS build_failed FROM b WHERE {_LABEL_SQL} IS NOT NULL"
_SAFE = "concat('safe_name=', replace(gh_project_name, '/', '_'))"


@query("save_projects", _builds(f"""
    , l AS ({_LABELLED}) SELECT gh_project_name AS project,
        {_SAFE} AS folder FROM l GROUP BY 1"""))
def save_projects(spark, sf_dir):
    _, saved = _project_folder(spark, sf_dir)
    return saved.select("project", F.element_at(F.split("path", "/"), -1).alias("folder"))


@query("scan_project_dir", _builds(f"""
    , l AS ({_LABELLED}) SELECT tr_build_id, gh_project_name, build_failed,
        {_SAFE} AS folder, round(tr_duration, 6) AS tr_duration FROM l"""))
def scan_project_dir(spark, sf_dir):
    folder, _ = _project_folder(spark, sf_dir)
    rows, _ = files.scan_project_dir(spark, folder)
    return rows.select("tr_build_id", PROJECT, LABEL, F.col("_folder").alias("folder"),
                       r6("tr_duration"))


@query("scan_time_series", _builds(f"""
    , l AS ({_LABELLED}) SELECT tr_build_id, epoch_us(gh_build_started_at) AS started_us,
        build_failed FROM l WHERE gh_project_name = 'org/proj3'"""))
def scan_time_series(spark, sf_dir):
    folder, _ = _project_folder(spark, sf_dir)
    rows = files.scan_time_series(spark, f"{folder}/safe_name=org_proj3")
    return rows.select(
        "tr_build_id", F.unix_micros("gh_build_started_at").alias("started_us"), LABEL)


@query("file_inventory", _builds(f"""
    , l AS ({_LABELLED}), g AS (SELECT {_SAFE} AS folder, count(*) AS rows,
        round_even(sum(1 - build_failed) * 100.0::DOUBLE / count(*), 2) AS pct_0,
        round_even(sum(build_failed) * 100.0::DOUBLE / count(*), 2) AS pct_1 FROM l GROUP BY 1)
    SELECT * FROM g UNION ALL SELECT 'total', CAST(sum(rows) AS BIGINT), NULL, NULL FROM g"""))
def file_inventory(spark, sf_dir):
    folder, _ = _project_folder(spark, sf_dir)
    inventory, total = files.file_inventory(spark, folder)
    none = F.lit(None).cast("double")
    return inventory.select("folder", "rows", "pct_0", "pct_1").union(total.select(
        F.lit("total"), "total_rows", none, none))


_RUN = "concat(proj, '#', CAST(exp AS STRING), '#', CAST(iter AS STRING))"


@query("run_log", V._on_entries(f"""
    , l AS (SELECT {_RUN} AS run_id, * FROM e)
    SELECT run_id, 'param' AS kind, 'project' AS key, proj AS text, NULL::DOUBLE AS value FROM l
    UNION ALL SELECT run_id, 'param', 'fold', CAST(exp AS STRING), NULL FROM l
    UNION ALL SELECT run_id, 'param', 'iteration', CAST(iter AS STRING), NULL FROM l WHERE iter > 1
    """ + " ".join(
        f"UNION ALL SELECT run_id, 'metric', 'test_{m}', NULL, round({m}, 6) FROM l"
        for m in ("F1", "AUC", "PR_AUC", "accuracy", "precision", "recall"))))
def run_log(spark, sf_dir):
    entries = V.entries(spark, sf_dir).drop("threshold").select(
        F.expr(_RUN).alias("run_id"), F.col("proj").alias("project"), F.col("exp").alias("fold"),
        # the first repeat leaves the field empty
        F.when(F.col("iter") > 1, F.col("iter").cast("string")).otherwise("").alias("iteration"),
        "F1", "AUC", "PR_AUC", "accuracy", "precision", "recall")
    return runlog.run_log(entries, prefix="test_").select(
        "run_id", "kind", "key", "text", r6("value"))


# -- queue --------------------------------------------------------------------
_PARSED = """SELECT message_id, CASE WHEN message_id % 8 = 5 THEN 'not JSON'
        WHEN message_id % 8 = 4 THEN 'not an object' WHEN message_id % 8 = 2 THEN 'no model_name'
        WHEN message_id % 8 = 3 THEN 'unknown model' END AS rejected,
    CASE message_id % 8 WHEN 0 THEN 'Stacked-LSTM' WHEN 1 THEN 'ConvLSTM' WHEN 6 THEN 'Padding'
        WHEN 7 THEN 'Stacked-BiLSTM' END AS model_name,
    CASE message_id % 8 WHEN 0 THEN 'rs' WHEN 1 THEN 'ga' WHEN 6 THEN 'ga'
        WHEN 7 THEN 'default' END AS tuner FROM q"""


@query("parse_json_message", with_views(f"SELECT * FROM p", q=X.MESSAGES_SQL, p=_PARSED))
def parse_json_message(spark, sf_dir):
    parsed = J.job_messages(X.messages(spark, sf_dir), "body")
    return parsed.select("message_id", "rejected", "model_name", "tuner")


@query("job_messages", with_views("""
    SELECT coalesce(model_name, rejected) AS outcome, tuner, count(*) AS messages FROM p
    GROUP BY 1, 2""", q=X.MESSAGES_SQL, p=_PARSED))
def job_messages(spark, sf_dir):
    """Messages through the stream: stored jobs and dead letters, counted."""
    queue, out = scratch_folder(spark, "queue"), scratch_folder(spark, "messages")
    X.messages(spark, sf_dir).select("body").repartition(3).write.text(queue)
    stream = J.store_messages(J.read_queue(spark, queue), out, f"{out}/checkpoint")
    stream.awaitTermination()
    jobs = spark.read.parquet(f"{out}/jobs").select(
        F.col("model_name").alias("outcome"), "tuner")
    dead = spark.read.parquet(f"{out}/dead").select(
        F.col("rejected").alias("outcome"), F.lit(None).cast("string").alias("tuner"))
    return jobs.union(dead).groupBy("outcome", "tuner").agg(F.count(F.lit(1)).alias("messages"))


@query("publish_jobs", with_views("""
    SELECT DISTINCT model_name, 'ga' AS tuner FROM p WHERE rejected IS NULL""",
    q=X.MESSAGES_SQL, p=_PARSED))
def publish_jobs(spark, sf_dir):
    """One queued message for each model that the table's valid messages name."""
    queue = scratch_folder(spark, "published")
    parsed = J.job_messages(X.messages(spark, sf_dir), "body")
    J.publish_jobs(spark, queue, parsed.filter(F.col("rejected").isNull()).select(
        "model_name").distinct())
    return spark.read.schema("model_name string, tuner string").json(queue)
