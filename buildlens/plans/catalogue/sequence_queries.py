"""Fold and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import sequences as S
from ...operators.timeline import Timeline
from ...schema import LABEL, PROJECT, TIME_ORDER
from .. import fixtures as X
from .registry import query, r6, with_views

ORDER = "gh_build_started_at, tr_build_id, tr_job_id"
FOLDS = {"n_folds": 5, "window": 300, "step": 150}
# integral features, so that window contents can be compared as text
FEATURES = ["gh_diff_files_added", "git_diff_src_churn", "gh_diff_files_modified", LABEL]
LENGTH = 10

_BASE = X.LABELLED_SQL + " WHERE event_type <> 'signup'"
_VECTOR = "[" + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in FEATURES) + "]"


def _rows(spark, sf_dir):
    return X.labelled(spark, sf_dir).filter(F.col(LABEL).isNotNull())


def _sql(select: str) -> str:
    return with_views(select, b=_BASE)


def _text(values):
    """An array of whole numbers as comma separated text."""
    return F.array_join(F.transform(values, lambda v: v.cast("int").cast("string")), ",")


def _duck_text(values: str) -> str:
    return f"array_to_string(list_transform({values}, lambda v: CAST(CAST(v AS INTEGER) AS VARCHAR)), ',')"


_POSITIONS = f"""SELECT *, row_number() OVER (PARTITION BY gh_project_name ORDER BY {ORDER}) - 1
    AS position, count(*) OVER (PARTITION BY gh_project_name) AS n FROM b"""
_FOLD_JOIN = """SELECT p.*, CAST(k + 1 AS INT) AS fold,
    CASE WHEN position < k * 150 + 300 THEN 'train' ELSE 'test' END AS split
    FROM p JOIN range(5) t(k) ON position >= k * 150 AND position < k * 150 + 360
    WHERE k * 150 + 360 <= n"""


@query("online_folds", _sql(f""", p AS ({_POSITIONS}), f AS ({_FOLD_JOIN})
    SELECT tr_build_id, gh_project_name, position, fold, split FROM f"""))
def online_folds(spark, sf_dir):
    return S.online_folds(_rows(spark, sf_dir), **FOLDS).select(
        "tr_build_id", PROJECT, "position", "fold", "split")


@query("fold_range_join", _sql(f""", p AS ({_POSITIONS}), f AS ({_FOLD_JOIN})
    SELECT gh_project_name, fold, split, count(*) AS rows, min(position) AS first,
        max(position) AS last, sum(build_failed) AS failed FROM f GROUP BY 1, 2, 3"""))
def fold_range_join(spark, sf_dir):
    """Rows joined to every fold range over the complete time line."""
    rows = _rows(spark, sf_dir)
    sizes = rows.groupBy(PROJECT).agg(F.count(F.lit(1)).alias("n"))
    placed = Timeline.of(rows, [PROJECT], TIME_ORDER).position("position").frame()
    placed = placed.withColumn("position", F.col("position") - 1).join(sizes, PROJECT)
    folds = S.assign_folds(placed, "position", "n", **FOLDS)
    return folds.groupBy(PROJECT, "fold", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("position").alias("first"),
        F.max("position").alias("last"), F.sum(LABEL).alias("failed"))


@query("fold_class_distribution", _sql(f""", p AS ({_POSITIONS}), f AS ({_FOLD_JOIN})
    SELECT gh_project_name, fold, split, count(build_failed) AS rows,
        round(avg(1 - build_failed), 6) AS passed_ratio,
        round(avg(build_failed), 6) AS failed_ratio FROM f GROUP BY 1, 2, 3"""))
def fold_class_distribution(spark, sf_dir):
    df = S.fold_class_distribution(S.online_folds(_rows(spark, sf_dir), **FOLDS))
    return df.select(PROJECT, "fold", "split", "rows", r6("passed_ratio"), r6("failed_ratio"))


_WINDOWED = f"""SELECT tr_build_id, gh_project_name, build_failed, list({_VECTOR}) OVER (
    PARTITION BY gh_project_name ORDER BY {ORDER} ROWS BETWEEN {LENGTH} PRECEDING
    AND 1 PRECEDING) AS w FROM b"""


@query("train_windows", _sql(f""", t AS ({_WINDOWED})
    SELECT tr_build_id, gh_project_name, build_failed, {_duck_text('flatten(w)')} AS cells
    FROM t WHERE len(w) = {LENGTH}"""))
def train_windows(spark, sf_dir):
    df = S.train_windows(_rows(spark, sf_dir), FEATURES, LENGTH)
    return df.select("tr_build_id", PROJECT, LABEL, _text(F.flatten("window")).alias("cells"))


@query("test_windows", _sql(f""", p AS ({_POSITIONS}), f AS ({_FOLD_JOIN}), t AS (
    SELECT tr_build_id, gh_project_name, fold, split, build_failed, list({_VECTOR}) OVER (
        PARTITION BY gh_project_name, fold ORDER BY CASE split WHEN 'test' THEN 1 ELSE 0 END,
        {ORDER} ROWS BETWEEN {LENGTH} PRECEDING AND 1 PRECEDING) AS w FROM f)
    SELECT tr_build_id, gh_project_name, fold, build_failed, {_duck_text('flatten(w)')} AS cells
    FROM t WHERE split = 'test'"""))
def test_windows(spark, sf_dir):
    folds = S.online_folds(_rows(spark, sf_dir), **FOLDS)
    df = S.test_windows(folds, FEATURES, LENGTH, [PROJECT, "fold"])
    return df.select(
        "tr_build_id", PROJECT, "fold", LABEL, _text(F.flatten("window")).alias("cells"))


@query("test_windows_padded", _sql(f""", t AS (
    SELECT tr_build_id, coalesce(list({_VECTOR}) OVER (PARTITION BY gh_project_name
        ORDER BY {ORDER} ROWS BETWEEN {LENGTH} PRECEDING AND 1 PRECEDING), []) AS w FROM b)
    SELECT tr_build_id, {_duck_text(f"list_concat(list_transform(range(({LENGTH} - len(w)) * "
                                    f"{len(FEATURES)}), lambda i: 0.0::DOUBLE), flatten(w))")} AS cells
    FROM t"""))
def test_windows_padded(spark, sf_dir):
    """Every row as a test row: early windows are padded with zero rows."""
    rows = _rows(spark, sf_dir).withColumn("split", F.lit(S.TEST))
    df = S.test_windows(rows, FEATURES, LENGTH)
    return df.select("tr_build_id", _text(F.flatten("window")).alias("cells"))


_GROUPS = {
    "change": ["gh_diff_files_added", "git_diff_src_churn", "gh_sloc"],
    "files": ["gh_diff_files_modified"],
    "result": [LABEL],
}


@query("group_window", _sql(f""", t AS ({_WINDOWED})
    SELECT tr_build_id, {_duck_text('''flatten(list_transform(w,
        lambda s: [s[1], s[2], s[3], 0.0, s[4], 0.0]))''')} AS cells
    FROM t WHERE len(w) = {LENGTH}"""))
def group_window(spark, sf_dir):
    df = S.train_windows(_rows(spark, sf_dir), FEATURES, LENGTH)
    grid = S.group_window(F.col("window"), FEATURES, _GROUPS)
    return df.select("tr_build_id", _text(F.flatten(F.flatten(grid))).alias("cells"))


@query("border_targets", _sql(f""", n AS ({_POSITIONS}), t AS (
    SELECT gh_project_name, position, list({_VECTOR}) OVER (PARTITION BY gh_project_name
        ORDER BY position ROWS BETWEEN {LENGTH} PRECEDING AND 1 PRECEDING) AS w FROM n),
    c AS (SELECT gh_project_name, position, flatten(list_concat(w[1:3], w[-3:])) AS v FROM t
        WHERE len(w) = {LENGTH}),
    u AS (SELECT gh_project_name, position, unnest(v) AS x,
        generate_subscripts(v, 1) AS i FROM c),
    m AS (SELECT i, min(x) AS lo, max(x) AS hi FROM u GROUP BY 1)
    SELECT gh_project_name, position + 1 AS position, CAST(u.i - 1 AS INT) AS slot,
        round((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS target
    FROM u JOIN m ON u.i = m.i"""))
def border_targets(spark, sf_dir):
    df = S.border_targets(_rows(spark, sf_dir), FEATURES, LENGTH)
    long = df.select(PROJECT, "position", F.posexplode("target").alias("slot", "target"))
    return long.select(PROJECT, "position", "slot", r6("target"))


@query("chrono_split", _sql(f""", n AS ({_POSITIONS})
    SELECT tr_build_id, CASE WHEN position + 1 <= n - CAST(ceil(round(n * 0.2, 6)) AS BIGINT)
        THEN 'train' ELSE 'validation' END AS part FROM n"""))
def chrono_split(spark, sf_dir):
    return S.chrono_split(_rows(spark, sf_dir)).select("tr_build_id", "part")
