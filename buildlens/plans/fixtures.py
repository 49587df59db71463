"""Build-shaped views of the driver's tables.

Each view is a list of (name, expression) pairs in SQL that Spark and DuckDB
both read, so a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_PROJECT = "concat('org/proj', CAST(user_id % 10 AS STRING))"

BUILDS = [
    ("tr_build_id", "event_id"),
    ("tr_job_id", "CAST(0 AS BIGINT)"),
    ("gh_project_name", _PROJECT),
    ("gh_build_started_at", "CAST(ts AS TIMESTAMP)"),
    ("tr_status", """CASE event_type WHEN 'error' THEN 'errored' WHEN 'purchase' THEN 'failed'
        WHEN 'signup' THEN 'canceled' ELSE 'passed' END"""),
    ("gh_by_core_team_member", """CASE WHEN event_id % 13 = 0 THEN NULL
        WHEN event_id % 4 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END
        ELSE CASE WHEN user_id % 2 = 0 THEN '1.0' ELSE '0.0' END END"""),
    ("tr_duration", "CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END"),
    ("tr_log_num_tests_failed",
     "CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id % 6 AS STRING) END"),
    ("gh_team_size",
     "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(user_id % 5 + 1 AS DOUBLE) END"),
    ("gh_sloc", """CASE WHEN event_id % 17 = 0 THEN NULL
        ELSE CAST(replace(replace(props, '{"k": ', ''), '}', '') AS DOUBLE) * 100 END"""),
    ("git_diff_src_churn",
     "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 23 AS DOUBLE) END"),
    ("gh_diff_files_added", "CAST(event_id % 4 AS DOUBLE)"),
    ("gh_diff_files_deleted",
     "CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(event_id % 3 AS DOUBLE) END"),
    ("gh_diff_files_modified",
     "CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 5 AS DOUBLE) END"),
    ("gh_diff_doc_files",
     "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(user_id % 3 AS DOUBLE) END"),
    ("gh_test_lines_per_kloc", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE value / 7 END"),
    ("gh_is_pr", "user_id % 2 = 0"),
]

# Columns that only the labelled view needs.
LABELLED = [
    *[p for p in BUILDS if p[0] not in ("tr_status", "gh_by_core_team_member")],
    ("build_failed", """CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 1
        WHEN 'signup' THEN NULL ELSE 0 END"""),
    ("gh_by_core_team_member", """CASE WHEN event_id % 13 = 0 THEN NULL
        WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END"""),
]

JOBS = [
    ("tr_build_id", "l_orderkey"),
    ("tr_job_id", "CAST(l_linenumber AS BIGINT)"),
    ("gh_project_name", "c_mktsegment"),
    ("gh_build_started_at", "CAST(o_orderdate AS TIMESTAMP)"),
    ("build_failed", "CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END"),
    ("gh_by_core_team_member", "CAST(l_suppkey % 4 AS DOUBLE)"),
    ("git_diff_src_churn", "l_quantity"),
    ("git_diff_test_churn", "CAST(l_partkey % 9 AS DOUBLE)"),
    ("gh_diff_src_files", "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 5 AS DOUBLE) END"),
    ("tr_duration", "l_extendedprice"),
    ("gh_test_cases_per_kloc", "l_discount"),
    ("gh_team_size", "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_suppkey % 5 AS DOUBLE) END"),
    ("gh_is_pr", "l_returnflag = 'R'"),
    ("day_week", "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END"),
]

SCORES = [
    ("proj", _PROJECT),
    ("exp", "CAST(event_id % 3 + 1 AS INT)"),
    ("iter", "CAST(event_id % 2 + 1 AS INT)"),
    ("y", "CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 1 ELSE 0 END"),
    ("p", """CAST((event_id * 37) % 101 + CASE WHEN event_type = 'error' THEN 40 ELSE 0 END
        AS DOUBLE) / CAST(141 AS DOUBLE)"""),
]

# Job messages: every kind a queue may carry.
MESSAGES = [
    ("message_id", "event_id"),
    ("body", """CASE event_id % 8
        WHEN 0 THEN '{"model_name": "Stacked-LSTM", "tuner": "rs"}'
        WHEN 1 THEN '{"model_name": "ConvLSTM"}'
        WHEN 2 THEN '{"tuner": "ga"}'
        WHEN 3 THEN '{"model_name": "Transformer", "tuner": "ga"}'
        WHEN 4 THEN '[1]'
        WHEN 5 THEN concat('job ', CAST(event_id AS STRING))
        WHEN 6 THEN '{"model_name": "Padding", "tuner": "ga"}'
        ELSE '{"model_name": "Stacked-BiLSTM", "tuner": "default"}' END"""),
]


#: Most rows of a large table that one task of a join holds, however large the table is.
ROWS_PER_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # the tables hold times without a zone; both engines read them as UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns])


def _sql(columns: list[tuple[str, str]], source: str) -> str:
    return "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in columns) + f" FROM {source}"


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "events"), BUILDS)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds with the label (null for cancelled ones) and a numeric committer flag."""
    df = _view(table(spark, sf_dir, "events"), LABELLED)
    return df.withColumn("gh_by_core_team_member", F.col("gh_by_core_team_member").cast("double"))


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """The table by its key, in as many tasks as its rows need (a count of file footers)."""
    tasks = -(-df.count() // ROWS_PER_TASK)
    return df.repartition(tasks, key) if tasks > int(
        df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of builds; they lie by build, so that what is grouped by build stays where it is."""
    lineitem, orders, customer = (
        table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    placed = _dealt(orders, "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = _dealt(lineitem, "l_orderkey").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    return _view(joined, JOBS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "events"), SCORES)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "events"), MESSAGES)


BUILDS_SQL = _sql(BUILDS, "events")
LABELLED_SQL = _sql(LABELLED, "events").replace("THEN 1.0 ELSE 0.0 END", "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
JOBS_SQL = _sql(
    JOBS,
    "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
)
SCORES_SQL = _sql(SCORES, "events")
MESSAGES_SQL = _sql(MESSAGES, "events")

