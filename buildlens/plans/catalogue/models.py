"""Importance, balancing, search and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import balance as B
from ...operators import fold_fits as FF
from ...operators import importance as I
from ...operators import modeling as M
from ...operators import prepare as P
from ...operators import profile as A
from ...operators import rank as R
from ...operators import sequences as S
from ...schema import LABEL, PROJECT
from ...session import scratch_folder
from .. import fixtures as X
from .. import flows
from .registry import query, r6, with_views
from .source_queries import _PARSED
from .sequence_queries import _BASE, _FOLD_JOIN, _POSITIONS, FOLDS

FEATURES = ["gh_diff_files_added", "git_diff_src_churn", "gh_diff_files_modified", "gh_sloc",
            "tr_duration", "gh_team_size"]
WINDOW_FEATURES = ["gh_diff_files_added", "gh_sloc", "tr_duration", LABEL]
LENGTH = 10
SPACE = {**M.COMMON, "time_step": [8, 10, 12]}
ONE = {"time_step": [LENGTH], "reg_param": [0.01], "max_iter": [10]}
ONLINE = {"top": 3, "n_folds": 2, "window": 300, "step": 150, "repeats": 1, "space": SPACE}


def _rows(spark, sf_dir):
    return X.labelled(spark, sf_dir).filter(F.col(LABEL).isNotNull())


# -- importances --------------------------------------------------------------
# Three importances that SQL can compute stand in for the models': correlation
# with the label, its covariance, and the relative spread of the feature.
def _measures_sql(name: str, expr: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS Feature, {expr} AS Importance FROM (SELECT {c} AS x, "
        f"CAST(build_failed AS DOUBLE) AS y FROM b WHERE {c} IS NOT NULL)" for c in FEATURES)
    return rows


_NORMAL = """SELECT Feature, CASE WHEN max(Importance) OVER () > min(Importance) OVER ()
    THEN (Importance - min(Importance) OVER ()) / (max(Importance) OVER () - min(Importance) OVER ())
    ELSE 1 END AS Importance FROM """
_VIEWS = {
    "b": _BASE,
    "rf": _measures_sql("rf", "abs(corr(x, y))"),
    "lg": _measures_sql("lg", "abs(covar_pop(x, y))"),
    "sv": _measures_sql("sv", "stddev_pop(x) / avg(x)"),
    "nrf": _NORMAL + "rf", "nlg": _NORMAL + "lg", "nsv": _NORMAL + "sv",
    "a": """SELECT Feature, nrf.Importance AS RF_Importance, nlg.Importance AS Log_Importance,
        nsv.Importance AS SVC_Importance,
        (nrf.Importance + nlg.Importance + nsv.Importance) / 3 AS Average_Importance
        FROM nrf JOIN nlg USING (Feature) JOIN nsv USING (Feature)""",
}


def _measured(df, measure):
    wide = df.agg(*[measure(F.col(c), F.col(LABEL).cast("double")).alias(c) for c in FEATURES])
    return wide.unpivot([], FEATURES, "Feature", "Importance")


def _given(spark, sf_dir):
    df = _rows(spark, sf_dir)
    return (
        _measured(df, lambda x, y: F.abs(A.correlation(x, y))),
        _measured(df, lambda x, y: F.abs(F.covar_pop(x, y))),
        _measured(df, lambda x, y: F.stddev_pop(x) / F.avg(x)),
    )


@query("normalise_importance", with_views(
    "SELECT Feature, round(Importance, 6) AS Importance FROM nrf",
    **{k: _VIEWS[k] for k in ("b", "rf", "nrf")}))
def normalise_importance(spark, sf_dir):
    rf, _, _ = _given(spark, sf_dir)
    return I.normalise_importance(rf).select("Feature", r6("Importance"))


_PARTS = ["RF_Importance", "Log_Importance", "SVC_Importance"]


@query("importance_join", with_views("""
    SELECT Feature, round(rf.Importance, 6) AS RF_Importance,
        round(lg.Importance, 6) AS Log_Importance, round(sv.Importance, 6) AS SVC_Importance
    FROM rf JOIN lg USING (Feature) JOIN sv USING (Feature)""",
    **{k: _VIEWS[k] for k in ("b", "rf", "lg", "sv")}))
def importance_join(spark, sf_dir):
    joined = I.importance_join(*_given(spark, sf_dir))
    return joined.select("Feature", *[r6(c) for c in _PARTS])


@query("combine_importance", with_views("SELECT Feature, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in [*_PARTS, "Average_Importance"]) + " FROM a", **_VIEWS))
def combine_importance(spark, sf_dir):
    df = I.combine_importance(*_given(spark, sf_dir))
    return df.select("Feature", *[r6(c) for c in [*_PARTS, "Average_Importance"]])


@query("top_features", with_views("""
    SELECT Feature, round(Average_Importance, 6) AS Average_Importance FROM a
    ORDER BY a.Average_Importance DESC, Feature LIMIT 3""", **_VIEWS))
def top_features(spark, sf_dir):
    df = R.top_features(I.combine_importance(*_given(spark, sf_dir)), 3)
    return df.select("Feature", r6("Average_Importance"))


@query("drop_low_importance", with_views("""
    SELECT tr_build_id, feature, round(v, 6) AS v FROM (
        UNPIVOT (SELECT tr_build_id, """ + ", ".join(FEATURES) + """ FROM b)
        ON """ + ", ".join(FEATURES) + """ INTO NAME feature VALUE v)
    WHERE feature IN (SELECT Feature FROM a WHERE Average_Importance >= 0.4)""", **_VIEWS))
def drop_low_importance(spark, sf_dir):
    importance = I.combine_importance(*_given(spark, sf_dir))
    df = _rows(spark, sf_dir).select("tr_build_id", *FEATURES)
    kept, _ = P.drop_low_importance(df, importance, 0.4)
    names = [c for c in kept.columns if c != "tr_build_id"]
    return kept.unpivot(["tr_build_id"], names, "feature", "v").filter(
        F.col("v").isNotNull()).select("tr_build_id", "feature", r6("v"))


@query("rf_importance")
def rf_importance(spark, sf_dir):
    return I.rf_importance(_rows(spark, sf_dir), FEATURES, trees=20)


@query("logistic_importance")
def logistic_importance(spark, sf_dir):
    return I.logistic_importance(_rows(spark, sf_dir), FEATURES)


@query("svc_importance")
def svc_importance(spark, sf_dir):
    return I.svc_importance(_rows(spark, sf_dir), FEATURES)


@query("aggregate_importance")
def aggregate_importance(spark, sf_dir):
    return I.aggregate_importance(_rows(spark, sf_dir), FEATURES, trees=20)


# -- balancing ----------------------------------------------------------------
_KNN_FEATURES = ["gh_diff_files_added", "git_diff_src_churn", "gh_diff_files_modified"]


def _fold_vectors(spark, sf_dir):
    folds = S.online_folds(_rows(spark, sf_dir), **FOLDS)
    return folds.filter(F.col("split") == S.TRAIN).withColumn(
        "vector", S.feature_vector(_KNN_FEATURES))


_TRAIN = f"""p AS ({_POSITIONS}), f AS ({_FOLD_JOIN}),
    t AS (SELECT gh_project_name, fold, tr_build_id, build_failed,
        {", ".join(f"coalesce({c}, 0) AS x{i}" for i, c in enumerate(_KNN_FEATURES))}
        FROM f WHERE split = 'train'),
    z AS (SELECT gh_project_name, fold, sum(build_failed) AS one, sum(1 - build_failed) AS zero
        FROM t GROUP BY 1, 2),
    y AS (SELECT t.* FROM t JOIN z USING (gh_project_name, fold)
        WHERE one <> zero AND build_failed = CASE WHEN zero < one THEN 0 ELSE 1 END)"""
_DISTANCE = " + ".join(f"(l.x{i} - r.x{i}) ^ 2" for i in range(len(_KNN_FEATURES)))


@query("minority_knn", with_views(f""", {_TRAIN},
    d AS (SELECT l.gh_project_name, l.fold, l.tr_build_id AS id, r.tr_build_id AS neighbour,
        sqrt({_DISTANCE}) AS distance FROM y l JOIN y r ON l.gh_project_name = r.gh_project_name
        AND l.fold = r.fold AND l.tr_build_id <> r.tr_build_id)
    SELECT gh_project_name, fold, id, CAST(k AS INT) AS place, neighbour,
        round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (
            PARTITION BY gh_project_name, fold, id ORDER BY distance, neighbour) AS k FROM d)
    WHERE k <= 5""", b=_BASE))
def minority_knn(spark, sf_dir):
    df = B.minority_knn(
        _fold_vectors(spark, sf_dir), [PROJECT, "fold"], "vector", "tr_build_id", bounded=True)
    long = df.select(PROJECT, "fold", "id", F.posexplode("neighbours").alias("_i", "_n"))
    return long.select(
        PROJECT, "fold", "id", (F.col("_i") + 1).alias("place"), "_n.neighbour",
        F.round("_n.distance", 6).alias("distance"))


@query("smote_balance", with_views(f""", {_TRAIN}
    SELECT gh_project_name, fold, CAST(l AS INT) AS label,
        CASE WHEN one > 0 AND zero > 0 THEN greatest(one, zero)
            ELSE CASE WHEN l = 1 THEN one ELSE zero END END AS rows
    FROM z, (VALUES (0), (1)) v(l)
    WHERE (one > 0 AND zero > 0) OR (l = 1 AND one > 0) OR (l = 0 AND zero > 0)""", b=_BASE))
def smote_balance(spark, sf_dir):
    """Class sizes of every fold's training set after balancing."""
    df = B.smote_balance(
        _fold_vectors(spark, sf_dir), [PROJECT, "fold"], "vector", "tr_build_id", bounded=True)
    # reading the vectors makes the interpolation part of the work
    known = df.filter(F.forall("vector", lambda v: v.isNotNull()))
    return known.groupBy(PROJECT, "fold", "label").agg(F.count(F.lit(1)).alias("rows"))


@query("smote_windows", with_views(f""", {_TRAIN}
    SELECT gh_project_name, fold, CASE WHEN one > 0 AND zero > 0 THEN 2 * greatest(one, zero)
        ELSE one + zero END - {LENGTH} AS windows FROM z""", b=_BASE))
def smote_windows(spark, sf_dir):
    rows = _fold_vectors(spark, sf_dir).withColumn("position", F.col("position") + 1)
    df = B.smote_windows(
        rows, [PROJECT, "fold"], "vector", "position", LENGTH, bounded=True)
    return df.groupBy(PROJECT, "fold").agg(F.count(F.lit(1)).alias("windows"))


# -- classifiers --------------------------------------------------------------
_PARAMS = {"time_step": LENGTH, "reg_param": 0.01, "max_iter": 10}


def _fit(spark, sf_dir, algorithm="logistic"):
    windows = S.train_windows(_rows(spark, sf_dir), WINDOW_FEATURES, LENGTH)
    return windows, M.fit_window_classifier(windows, WINDOW_FEATURES, _PARAMS, algorithm)


@query("fit_window_classifier")
def fit_window_classifier(spark, sf_dir):
    _, fitted = _fit(spark, sf_dir)
    row = {k: float(v) for k, v in fitted.entry.items()}
    row["validation_loss"] = float(fitted.validation_loss)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


@query("score_windows")
def score_windows(spark, sf_dir):
    windows, fitted = _fit(spark, sf_dir)
    return M.score_windows(fitted, windows).select("tr_build_id", PROJECT, "y", "p", "said")


def _search(spark, sf_dir, strategy):
    result = M.online_validation(
        _rows(spark, sf_dir), WINDOW_FEATURES, strategy, **{**ONLINE, "n_folds": 1})
    return result.candidates


@query("search_random")
def search_random(spark, sf_dir):
    return _search(spark, sf_dir, "random")


@query("search_genetic")
def search_genetic(spark, sf_dir):
    return _search(spark, sf_dir, "genetic")


@query("search_default")
def search_default(spark, sf_dir):
    return _search(spark, sf_dir, "default")


@query("top_candidates")
def top_candidates(spark, sf_dir):
    return R.top_candidates(_search(spark, sf_dir, "random"), 3)


@query("online_validation")
def online_validation(spark, sf_dir):
    result = M.online_validation(_rows(spark, sf_dir), WINDOW_FEATURES, "random", **ONLINE)
    return result.entries


@query("cross_project_validation")
def cross_project_validation(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    best = R.top_datasets(rows, 1).first()["project"]
    return M.cross_project_validation(rows, best, WINDOW_FEATURES, "genetic").entries


@query("adapted_validation")
def adapted_validation(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    best = R.top_datasets(rows, 1).first()["project"]
    entries, _ = M.adapted_validation(rows, best, WINDOW_FEATURES, _PARAMS, limit=1.0)
    return entries


@query("border_reconstruction")
def border_reconstruction(spark, sf_dir):
    card, _ = M.border_reconstruction(_rows(spark, sf_dir), WINDOW_FEATURES, LENGTH)
    return card


@query("rebalanced_folds", with_views(f""", {_TRAIN}
    SELECT gh_project_name AS proj, fold AS exp, CAST(l AS INT) AS label,
        CASE WHEN l = 1 THEN one ELSE zero END AS real,
        CASE WHEN one > 0 AND zero > 0 THEN greatest(one, zero)
            ELSE CASE WHEN l = 1 THEN one ELSE zero END END AS rows
    FROM z, (VALUES (0), (1)) v(l)
    WHERE (one > 0 AND zero > 0) OR (l = 1 AND one > 0) OR (l = 0 AND zero > 0)""", b=_BASE))
def rebalanced_folds(spark, sf_dir):
    """Class sizes of every fold's training rows with the synthetic ones that its task adds."""
    rows = FF.rebalanced_folds(M.fold_rows(_rows(spark, sf_dir), WINDOW_FEATURES, **FOLDS))
    return rows.groupBy("proj", "exp", F.col("y").alias("label")).agg(
        F.count_if(~F.col("synthetic")).alias("real"), F.count(F.lit(1)).alias("rows"))


@query("online_validation_rebalanced")
def online_validation_rebalanced(spark, sf_dir):
    result = M.online_validation(
        _rows(spark, sf_dir), WINDOW_FEATURES, "random", balance=FF.BEFORE_WINDOW, **ONLINE)
    return result.entries


@query("run_jobs", with_views("""
    SELECT CASE WHEN rejected IS NULL THEN 'done' ELSE 'dead' END AS state, model_name, tuner,
        rejected AS reason, count(*) AS messages FROM p GROUP BY 1, 2, 3, 4""",
    q=X.MESSAGES_SQL, p=_PARSED))
def run_jobs(spark, sf_dir):
    """Every message of the table through a worker, by its state at the end."""
    queue, out = scratch_folder(spark, "queue"), scratch_folder(spark, "runs")
    X.messages(spark, sf_dir).select("body").repartition(3).write.text(queue)
    flows.work(
        spark, queue, _rows(spark, sf_dir), out, files_per_batch=1_000, features=WINDOW_FEATURES,
        online=ONLINE, cross={"space": ONE}, border={"length": LENGTH}).awaitTermination()
    states = spark.read.parquet(f"{out}/states")
    return states.groupBy("state", "model_name", "tuner", "reason").agg(
        F.count(F.lit(1)).alias("messages"))
