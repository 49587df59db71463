"""Column names, header dialects and feature groups of the build tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Names and lists below are part of the data format and have to be spelled
# exactly like this for files and results to match.

# Canonical job table, in output order.
CANONICAL = {
    "tr_status": T.StringType(),
    "gh_project_name": T.StringType(),
    "gh_is_pr": T.BooleanType(),
    "gh_team_size": T.DoubleType(),
    "git_num_commits": T.DoubleType(),
    "gh_num_issue_comments": T.DoubleType(),
    "gh_num_commit_comments": T.DoubleType(),
    "gh_num_pr_comments": T.DoubleType(),
    "git_diff_src_churn": T.DoubleType(),
    "git_diff_test_churn": T.DoubleType(),
    "gh_diff_files_added": T.DoubleType(),
    "gh_diff_files_deleted": T.DoubleType(),
    "gh_diff_files_modified": T.DoubleType(),
    "gh_diff_tests_added": T.DoubleType(),
    "gh_diff_tests_deleted": T.DoubleType(),
    "gh_diff_src_files": T.DoubleType(),
    "gh_diff_doc_files": T.DoubleType(),
    "gh_diff_other_files": T.DoubleType(),
    "gh_num_commits_on_files_touched": T.DoubleType(),
    "gh_sloc": T.DoubleType(),
    "gh_test_lines_per_kloc": T.DoubleType(),
    "gh_test_cases_per_kloc": T.DoubleType(),
    "gh_asserts_cases_per_kloc": T.DoubleType(),
    "gh_by_core_team_member": T.StringType(),
    "gh_build_started_at": T.TimestampType(),
    "tr_log_num_tests_failed": T.DoubleType(),
    "tr_duration": T.DoubleType(),
    "tr_build_id": T.LongType(),
    "tr_job_id": T.LongType(),
}

# Header dialects: only the columns whose source name differs from the
# canonical one are listed.
DIALECTS = {
    "push": {
        "git_num_commits": "gh_num_commits_in_push",
    },
    "short": {
        "tr_status": "status",
        "gh_project_name": "project_name",
        "gh_is_pr": "is_pr",
        "gh_team_size": "team_size",
        "git_num_commits": "num_commits",
        "gh_num_issue_comments": "num_issue_comments",
        "gh_num_commit_comments": "num_commit_comments",
        "gh_num_pr_comments": "num_pr_comments",
        "git_diff_src_churn": "src_churn",
        "git_diff_test_churn": "test_churn",
        "gh_diff_files_added": "files_added",
        "gh_diff_files_deleted": "files_deleted",
        "gh_diff_files_modified": "files_modified",
        "gh_diff_tests_added": "tests_added",
        "gh_diff_tests_deleted": "tests_deleted",
        "gh_diff_src_files": "src_files",
        "gh_diff_doc_files": "doc_files",
        "gh_diff_other_files": "other_files",
        "gh_num_commits_on_files_touched": "commits_on_files_touched",
        "gh_sloc": "sloc",
        "gh_test_lines_per_kloc": "test_lines_per_kloc",
        "gh_test_cases_per_kloc": "test_cases_per_kloc",
        "gh_asserts_cases_per_kloc": "asserts_per_kloc",
        "gh_by_core_team_member": "main_team_member",
        "gh_build_started_at": "started_at",
        "tr_log_num_tests_failed": "failed",
        "tr_duration": "duration",
        "tr_build_id": "build_id",
        "tr_job_id": "job_id",
    },
    "job": {
        "git_diff_src_churn": "gh_src_churn",
        "git_diff_test_churn": "gh_test_churn",
        "gh_diff_files_added": "gh_files_added",
        "gh_diff_files_deleted": "gh_files_deleted",
        "gh_diff_files_modified": "gh_files_modified",
        "gh_diff_tests_added": "gh_tests_added",
        "gh_diff_tests_deleted": "gh_tests_deleted",
        "gh_diff_src_files": "gh_src_files",
        "gh_diff_doc_files": "gh_doc_files",
        "gh_diff_other_files": "gh_other_files",
        "gh_num_commits_on_files_touched": "gh_commits_on_files_touched",
        "gh_build_started_at": "tr_started_at",
        "tr_log_num_tests_failed": "tr_tests_failed",
    },
}

# Feature groups used to shape one time step into a small grid.
FEATURE_GROUPS = {
    "project": [
        "gh_sloc", "gh_test_cases_per_kloc", "proj_fail_rate_history",
        "proj_fail_rate_recent",
    ],
    "code_change": [
        "git_diff_src_churn", "git_diff_test_churn", "gh_diff_files_added",
        "gh_diff_files_deleted", "gh_diff_tests_added", "gh_diff_src_files",
        "gh_diff_doc_files", "num_files_edited",
    ],
    "team": [
        "gh_team_size", "gh_num_issue_comments", "gh_num_pr_comments",
        "gh_num_commit_comments", "same_committer", "num_distinct_authors",
        "comm_avg_experience", "comm_fail_rate_history",
        "comm_fail_rate_recent",
    ],
    "time": [
        "year_of_start", "month_of_start", "day_of_start", "day_week",
        "tr_duration", "prev_build_result",
    ],
    "config_pr": ["gh_is_pr", "no_config_edited"],
}

# Columns filled with zero, with the project mean, and with the median.
ZERO_FILLED = [
    "tr_log_num_tests_failed", "git_num_commits", "gh_num_issue_comments",
    "gh_num_pr_comments", "gh_num_commit_comments", "git_diff_src_churn",
    "git_diff_test_churn", "gh_diff_files_added", "gh_diff_files_deleted",
    "gh_diff_files_modified", "gh_diff_src_files", "gh_diff_doc_files",
    "gh_diff_other_files", "gh_diff_tests_added", "gh_diff_tests_deleted",
    "gh_num_commits_on_files_touched",
]
MEAN_FILLED = [
    "gh_test_lines_per_kloc", "gh_test_cases_per_kloc",
    "gh_asserts_cases_per_kloc",
]
MEDIAN_FILLED = {"gh_team_size": 1.0, "gh_sloc": 0.0}

# How the measures of several jobs become one build.
BUILD_SUMS = [
    "gh_num_issue_comments", "gh_num_pr_comments", "git_diff_src_churn",
    "git_diff_test_churn", "gh_diff_files_added", "gh_diff_files_deleted",
    "gh_diff_files_modified", "gh_diff_tests_added", "gh_diff_tests_deleted",
    "gh_diff_src_files", "gh_diff_doc_files", "gh_diff_other_files",
    "gh_num_commits_on_files_touched", "gh_num_commit_comments",
    "tr_log_num_tests_failed", "num_files_edited",
]
BUILD_MEANS = [
    "gh_team_size", "gh_sloc", "gh_test_lines_per_kloc",
    "gh_test_cases_per_kloc", "gh_asserts_cases_per_kloc",
    "proj_fail_rate_history", "proj_fail_rate_recent",
    "comm_fail_rate_history", "comm_fail_rate_recent", "comm_avg_experience",
]
BUILD_MAXIMA = [
    "gh_is_pr", "gh_by_core_team_member", "tr_duration", "same_committer",
    "no_config_edited", "num_distinct_authors",
]
BUILD_FIRSTS = [
    "year_of_start", "month_of_start", "day_of_start", "hour_of_start",
    "elapsed_days_last_build", "prev_build_result", "day_week",
]

# Columns scaled to [0, 1] per project before training.
SCALED = [
    "gh_num_issue_comments", "gh_num_pr_comments", "gh_team_size", "gh_sloc",
    "git_diff_src_churn", "git_diff_test_churn", "gh_diff_files_added",
    "gh_diff_files_deleted", "gh_diff_files_modified", "gh_diff_tests_added",
    "gh_diff_tests_deleted", "gh_diff_src_files", "gh_diff_doc_files",
    "gh_diff_other_files", "gh_num_commits_on_files_touched",
    "gh_test_lines_per_kloc", "gh_test_cases_per_kloc",
    "gh_asserts_cases_per_kloc", "gh_num_commit_comments",
    "tr_log_num_tests_failed", "tr_duration", "year_of_start",
    "elapsed_days_last_build", "proj_fail_rate_history",
    "proj_fail_rate_recent", "comm_fail_rate_history",
    "comm_fail_rate_recent", "comm_avg_experience", "num_files_edited",
    "num_distinct_authors", "month_of_start", "day_of_start",
    "hour_of_start", "day_week",
]

# Period of each cyclical time column.
PERIODS = {"month_of_start": 12, "day_of_start": 31, "hour_of_start": 24, "day_week": 7}

# Models a queued job may name, and the default search.
JOB_MODELS = ["Stacked-LSTM", "Stacked-BiLSTM", "ConvLSTM", "Padding"]
DEFAULT_TUNER = "ga"

# Weights of the combined model score.
SCORE_WEIGHTS = {
    "AUC": 0.2, "F1": 0.25, "accuracy": 0.0, "recall": 0.3,
    "precision": 0.1, "PR_AUC": 0.15,
}
METRICS = ["F1", "AUC", "accuracy", "recall", "precision", "PR_AUC"]

# What a run log keeps.
LOG_PARAMS = [
    "project", "fold", "iteration", "time_step", "threshold", "algo", "reg_param", "max_iter",
]
LOG_METRICS = [
    "F1", "AUC", "PR_AUC", "accuracy", "precision", "recall",
    "validation_loss", "score",
]
# --- end of fixed values ----------------------------------------------------

PROJECT = "gh_project_name"
STARTED = "gh_build_started_at"
LABEL = "build_failed"
COMMITTER = "gh_by_core_team_member"
#: Order of rows inside a project; the ids break ties in time.
TIME_ORDER = [STARTED, "tr_build_id", "tr_job_id"]


def source_name(dialect: str, column: str) -> str:
    """Header name of a canonical column in one dialect."""
    return DIALECTS[dialect].get(column, column)


def match_dialect(header: list[str]) -> str | None:
    """The dialect sharing most names with a header, or None if none share any."""
    present = set(header)
    hits = {
        name: sum(source_name(name, column) in present for column in CANONICAL)
        for name in DIALECTS
    }
    best = max(hits, key=hits.get)
    return best if hits[best] else None
