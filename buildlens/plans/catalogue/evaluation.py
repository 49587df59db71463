"""Curves, thresholds, metric entries and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import evaluate as E
from ...operators import profile as A
from ...operators import rank as R
from .. import fixtures as X
from .registry import query, r6, with_views

_KEYS = "proj, exp, iter"

_SWEEP = f"""SELECT *, sum(pos) OVER (PARTITION BY {_KEYS} ORDER BY p DESC) AS tp,
    sum(n) OVER (PARTITION BY {_KEYS} ORDER BY p DESC) AS seen,
    sum(pos) OVER (PARTITION BY {_KEYS}) AS pos_all, sum(n) OVER (PARTITION BY {_KEYS}) AS n_all
    FROM (SELECT {_KEYS}, p, count(*) AS n, sum(y) AS pos FROM s GROUP BY {_KEYS}, p)"""
_POINTS = """SELECT *, CAST(tp AS DOUBLE) / seen AS pr,
    CASE WHEN pos_all > 0 THEN CAST(tp AS DOUBLE) / pos_all ELSE 1 END AS re FROM w"""


def _swept(select: str) -> str:
    return with_views(select, s=X.SCORES_SQL, w=_SWEEP, c=_POINTS)


@query("pr_curve", _swept(f"""
    SELECT {_KEYS}, round(p, 6) AS threshold, round(pr, 6) AS precision, round(re, 6) AS recall
    FROM c UNION ALL SELECT DISTINCT {_KEYS}, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM s"""))
def pr_curve(spark, sf_dir):
    df = E.pr_curve(X.scores(spark, sf_dir))
    return df.select(*E.KEYS, r6("threshold"), r6("precision"), r6("recall"))


def _best(rank: str) -> str:
    return _swept(f"""
        , f AS (SELECT *, 2 * (pr * re) / (pr + re + 1e-10) AS f1 FROM c)
        , r AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY {rank}, p) AS k FROM f)
        SELECT {_KEYS}, round(p, 6) AS threshold, round(pr, 6) AS precision,
            round(re, 6) AS recall, round(f1, 6) AS F1 FROM r WHERE k = 1""")


def _rounded(df):
    return df.select(*E.KEYS, r6("threshold"), r6("precision"), r6("recall"), r6("F1"))


@query("best_threshold_f1", _best("f1 DESC"))
def best_threshold_f1(spark, sf_dir):
    return _rounded(E.best_threshold(X.scores(spark, sf_dir), "f1"))


@query("best_threshold_recall", _best(
    "CASE WHEN re >= 0.6 THEN 0 ELSE 1 END, CASE WHEN re >= 0.6 THEN pr ELSE re END DESC"))
def best_threshold_recall(spark, sf_dir):
    return _rounded(E.best_threshold(X.scores(spark, sf_dir), "recall", 0.6))


@query("best_threshold_precision", _best(
    "CASE WHEN pr >= 0.9 THEN 0 ELSE 1 END, CASE WHEN pr >= 0.9 THEN re ELSE pr END DESC"))
def best_threshold_precision(spark, sf_dir):
    return _rounded(E.best_threshold(X.scores(spark, sf_dir), "precision", 0.9))


@query("roc_curve", _swept(f"""
    SELECT {_KEYS}, round(p, 6) AS threshold,
        round(CAST(seen - tp AS DOUBLE) / nullif(n_all - pos_all, 0), 6) AS fpr,
        round(CAST(tp AS DOUBLE) / nullif(pos_all, 0), 6) AS tpr
    FROM c UNION ALL SELECT DISTINCT {_KEYS}, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM s"""))
def roc_curve(spark, sf_dir):
    df = E.roc_curve(X.scores(spark, sf_dir))
    return df.select(*E.KEYS, r6("threshold"), r6("fpr"), r6("tpr"))


# the rank statistic: mean rank of the positives
_AUC = f"""SELECT {_KEYS}, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)
    / nullif(CAST(sum(y) AS DOUBLE) * sum(1 - y), 0) AS AUC FROM (
    SELECT *, rank() OVER (PARTITION BY {_KEYS} ORDER BY p)
        + (count(*) OVER (PARTITION BY {_KEYS}, p) - 1) / 2.0::DOUBLE AS rk FROM s)
    GROUP BY {_KEYS}"""
_PREVIOUS = f"""SELECT *, coalesce(lag(pr) OVER (PARTITION BY {_KEYS} ORDER BY p DESC), 1) AS pr0,
    coalesce(lag(re) OVER (PARTITION BY {_KEYS} ORDER BY p DESC), 0) AS re0 FROM c"""


@query("roc_auc", with_views(f"SELECT {_KEYS}, round(AUC, 6) AS AUC FROM a",
                             s=X.SCORES_SQL, a=_AUC))
def roc_auc(spark, sf_dir):
    return E.roc_auc(X.scores(spark, sf_dir)).select(*E.KEYS, r6("AUC"))


@query("average_precision", _swept(f""", q AS ({_PREVIOUS})
    SELECT {_KEYS}, round(sum((re - re0) * pr), 6) AS PR_AUC FROM q GROUP BY {_KEYS}"""))
def average_precision(spark, sf_dir):
    return E.average_precision(X.scores(spark, sf_dir)).select(*E.KEYS, r6("PR_AUC"))


@query("pr_auc_trapezoid", _swept(f""", q AS ({_PREVIOUS})
    SELECT {_KEYS}, round(sum((re - re0) * (pr + pr0) / 2), 6) AS PR_AUC FROM q
    GROUP BY {_KEYS}"""))
def pr_auc_trapezoid(spark, sf_dir):
    return E.pr_auc_trapezoid(X.scores(spark, sf_dir)).select(*E.KEYS, r6("PR_AUC"))


def _confusion_sql(threshold: str) -> str:
    hit = f"p >= {threshold}"
    return f"""SELECT {_KEYS},
        CAST(sum(CASE WHEN ({hit}) = (y = 1) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy,
        coalesce(CAST(sum(CASE WHEN {hit} THEN y ELSE 0 END) AS DOUBLE)
            / nullif(sum(CASE WHEN {hit} THEN 1 ELSE 0 END), 0), 0) AS precision,
        coalesce(CAST(sum(CASE WHEN {hit} THEN y ELSE 0 END) AS DOUBLE) / nullif(sum(y), 0), 0)
            AS recall,
        coalesce(2 * CAST(sum(CASE WHEN {hit} THEN y ELSE 0 END) AS DOUBLE)
            / nullif(sum(CASE WHEN {hit} THEN 1 ELSE 0 END) + sum(y), 0), 0) AS F1"""


def _round_all(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_CONFUSION = ["accuracy", "precision", "recall", "F1"]


@query("confusion_metrics", with_views(
    f"SELECT {_KEYS}, {_round_all(_CONFUSION)} FROM m",
    s=X.SCORES_SQL, m=_confusion_sql("0.5") + f" FROM s GROUP BY {_KEYS}"))
def confusion_metrics(spark, sf_dir):
    df = E.confusion_metrics(X.scores(spark, sf_dir), 0.5)
    return df.select(*E.KEYS, *[r6(c) for c in _CONFUSION])


_ENTRIES = {
    "s": X.SCORES_SQL, "w": _SWEEP, "c": _POINTS, "a": _AUC, "q": _PREVIOUS,
    "h": f"""SELECT {_KEYS}, p AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS}
        ORDER BY 2 * (pr * re) / (pr + re + 1e-10) DESC, p) AS k FROM c) WHERE k = 1""",
    "m": _confusion_sql("threshold") + f""", threshold
        FROM s JOIN h USING ({_KEYS}) GROUP BY {_KEYS}, threshold""",
    "g": f"SELECT {_KEYS}, sum((re - re0) * pr) AS PR_AUC FROM q GROUP BY {_KEYS}",
    "e": f"""SELECT {_KEYS}, AUC, PR_AUC, accuracy, precision, recall, F1, threshold
        FROM m JOIN a USING ({_KEYS}) JOIN g USING ({_KEYS})""",
}
_ENTRY_COLUMNS = ["AUC", "PR_AUC", "accuracy", "precision", "recall", "F1", "threshold"]


def _on_entries(select: str) -> str:
    return with_views(select, **_ENTRIES)


def entries(spark, sf_dir):
    return E.metric_entries(X.scores(spark, sf_dir))


@query("metric_entries", _on_entries(f"SELECT {_KEYS}, {_round_all(_ENTRY_COLUMNS)} FROM e"))
def metric_entries(spark, sf_dir):
    return entries(spark, sf_dir).select(*E.KEYS, *[r6(c) for c in _ENTRY_COLUMNS])


_METRICS = "F1, AUC, accuracy, recall, precision, PR_AUC"


@query("metric_gate", _on_entries(f"""
    SELECT {_KEYS}, round(F1, 6) AS F1, round(AUC, 6) AS AUC FROM e
    WHERE greatest({_METRICS}) <= 0.72"""))
def metric_gate(spark, sf_dir):
    """The gate is set where it splits these entries."""
    return E.metric_gate(entries(spark, sf_dir), 0.72).select(*E.KEYS, r6("F1"), r6("AUC"))


_SCORE = "0.2 * AUC + 0.25 * F1 + 0.3 * recall + 0.1 * precision + 0.15 * PR_AUC"


@query("weighted_score", _on_entries(f"""
    SELECT {_KEYS}, round(CASE WHEN greatest({_METRICS}) >= 0.72 OR least({_METRICS}) < 0.3
        THEN -1 ELSE {_SCORE} END, 6) AS score FROM e"""))
def weighted_score(spark, sf_dir):
    df = E.weighted_score(entries(spark, sf_dir), upper=0.72, lower=0.3)
    return df.select(*E.KEYS, r6("score"))


_AVGS = "avg(F1) AS F1, avg(AUC) AS AUC, avg(accuracy) AS accuracy, avg(PR_AUC) AS PR_AUC"
_ROLLED = ["F1", "AUC", "accuracy", "PR_AUC"]
_NO_STD = ", ".join(f"NULL::DOUBLE AS std_{m}" for m in _ROLLED)


@query("metric_rollup", _on_entries(f"""
    , fold AS (SELECT proj, exp, {_AVGS} FROM e GROUP BY 1, 2)
    , project AS (SELECT proj, {_AVGS} FROM e GROUP BY 1)
    , u AS (SELECT 'fold' AS level, *, {_NO_STD} FROM fold
        UNION ALL SELECT 'dataset', proj, NULL, {_AVGS}, {_NO_STD} FROM fold GROUP BY proj
        UNION ALL SELECT 'project', proj, NULL, F1, AUC, accuracy, PR_AUC, {_NO_STD} FROM project
        UNION ALL SELECT 'pipeline', NULL, NULL, {_AVGS}, stddev_samp(F1), stddev_samp(AUC),
            stddev_samp(accuracy), stddev_samp(PR_AUC) FROM project)
    SELECT level, proj, exp, {_round_all(_ROLLED + [f'std_{m}' for m in _ROLLED])} FROM u"""))
def metric_rollup(spark, sf_dir):
    df = A.metric_rollup(entries(spark, sf_dir))
    return df.select(
        "level", "proj", "exp", *[r6(m) for m in _ROLLED], *[r6(f"std_{m}") for m in _ROLLED])


@query("metrics_by_project_exp", _on_entries("SELECT proj, exp, " + ", ".join(
    f"round(avg({c}), 6) AS {c}" for c in _ENTRY_COLUMNS) + " FROM e GROUP BY 1, 2"))
def metrics_by_project_exp(spark, sf_dir):
    df = A.metrics_by_project_exp(entries(spark, sf_dir))
    return df.select("proj", "exp", *[r6(c) for c in _ENTRY_COLUMNS])


@query("metric_box_stats", _on_entries("""
    , l AS (SELECT proj, unnest(['AUC', 'accuracy', 'F1']) AS metric,
        unnest([AUC, accuracy, F1]) AS v FROM e)
    SELECT proj, metric, round(min(v), 6) AS low, round(quantile_cont(v, 0.25), 6) AS q1,
        round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3,
        round(max(v), 6) AS high FROM l GROUP BY 1, 2"""))
def metric_box_stats(spark, sf_dir):
    df = A.metric_box_stats(entries(spark, sf_dir))
    return df.select("proj", "metric", *[r6(c) for c in ("low", "q1", "median", "q3", "high")])


def _phase_sql(phase: str, group: str) -> str:
    stats = ", ".join(
        [f"round(avg({m}), 6) AS avg_{m}" for m in _ROLLED]
        + [f"round(stddev_samp({m}), 6) AS std_{m}" for m in _ROLLED])
    return f"SELECT {phase} AS phase, count(*) AS entries, {stats} FROM e {group}"


_PHASE = "CASE WHEN proj = 'org/proj0' THEN 'bellwether' ELSE 'cross_project' END"


@query("bellwether_phase_summary", _on_entries(
    _phase_sql(_PHASE, "GROUP BY 1") + " UNION ALL " + _phase_sql("'overall'", "")))
def bellwether_phase_summary(spark, sf_dir):
    phase = F.when(F.col("proj") == "org/proj0", "bellwether").otherwise("cross_project")
    df = A.phase_summary(entries(spark, sf_dir).withColumn("phase", phase))
    return df.select("phase", "entries", *[r6(f"avg_{m}") for m in _ROLLED],
                     *[r6(f"std_{m}") for m in _ROLLED])


@query("bellwether", _on_entries("""
    SELECT proj, round(avg(F1), 6) AS F1, round(avg(PR_AUC), 6) AS PR_AUC FROM e GROUP BY 1
    ORDER BY avg(F1) DESC, proj LIMIT 1"""))
def bellwether(spark, sf_dir):
    return R.bellwether(entries(spark, sf_dir)).select("proj", r6("F1"), r6("PR_AUC"))


@query("best_entry_per_project", _on_entries(f"""
    SELECT {_KEYS}, round(F1, 6) AS F1, round(threshold, 6) AS threshold FROM (
        SELECT *, row_number() OVER (PARTITION BY proj ORDER BY F1 DESC, exp, iter) AS k
        FROM e WHERE greatest({_METRICS}) <= 0.99) WHERE k = 1"""))
def best_entry_per_project(spark, sf_dir):
    best = R.best_entry_per_project(E.metric_gate(entries(spark, sf_dir)))
    return best.select(*E.KEYS, r6("F1"), r6("threshold"))


# -- regression ---------------------------------------------------------------
# Targets are folds and projects; y is a build's duration and p the previous
# build's, both scaled per target.
_REGRESSION = f"""
    SELECT concat(CASE WHEN event_id % 2 = 0 THEN 'head_' ELSE 'tail_' END,
        CAST(event_id % 3 AS STRING), ':f', CAST(user_id % 10 AS STRING)) AS target,
        event_id, value FROM events"""
_SCALED = """
    SELECT target, (value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS y,
        coalesce((prev - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 0.5) AS p, lo, hi
    FROM (SELECT *, min(value) OVER (PARTITION BY target) AS lo,
        max(value) OVER (PARTITION BY target) AS hi,
        lag(value) OVER (PARTITION BY target ORDER BY event_id) AS prev FROM v)"""
_ORIGINAL = """SELECT *, y * CASE WHEN hi > lo THEN hi - lo ELSE 1 END + lo AS oy,
    least(greatest(p, 0), 1 - 1e-6) * CASE WHEN hi > lo THEN hi - lo ELSE 1 END + lo AS op
    FROM x"""
_PER_TARGET = """SELECT target, avg((oy - op) ^ 2) AS mse, avg(abs(oy - op)) AS mae,
    1 - sum((oy - op) ^ 2) / (var_pop(oy) * count(*)) AS r2, median(abs(oy - op)) AS medae,
    avg((y - p) ^ 2) AS msen, avg(abs(y - p)) AS maen,
    1 - sum((y - p) ^ 2) / (var_pop(y) * count(*)) AS r2n FROM o GROUP BY 1"""


def _regression(spark, sf_dir):
    from ...operators.timeline import Timeline

    side = F.when(F.col("event_id") % 2 == 0, "head_").otherwise("tail_")
    target = F.concat(side, (F.col("event_id") % 3).cast("string"), F.lit(":f"),
                      (F.col("user_id") % 10).cast("string"))
    rows = X.table(spark, sf_dir, "events").select(target.alias("target"), "event_id", "value")
    bounds = rows.groupBy("target").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    line = Timeline.of(rows, ["target"], ["event_id"]).previous({"prev": F.col("value")})
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    return line.frame().join(bounds, "target").select(
        "target", "low", "high", ((F.col("value") - F.col("low")) / width).alias("y"),
        F.coalesce((F.col("prev") - F.col("low")) / width, F.lit(0.5)).alias("p"))


@query("regression_scorecard", with_views("""
    SELECT round(avg(mse), 6) AS MSE, round(avg(mae), 6) AS MAE, round(avg(r2), 6) AS R2,
        round(avg(medae), 6) AS MedAE, round(avg(msen), 6) AS MSE_norm,
        round(avg(maen), 6) AS MAE_norm, round(avg(r2n), 6) AS R2_norm FROM t""",
    v=_REGRESSION, x=_SCALED, o=_ORIGINAL, t=_PER_TARGET))
def regression_scorecard(spark, sf_dir):
    df = E.regression_scorecard(_regression(spark, sf_dir))
    return df.select(*[r6(c) for c in df.columns])


@query("low_r2_features", with_views("""
    SELECT DISTINCT split_part(target, ':', 2) AS feature FROM t WHERE r2 < -1.0""",
    v=_REGRESSION, x=_SCALED, o=_ORIGINAL, t=_PER_TARGET))
def low_r2_features(spark, sf_dir):
    return E.low_r2_features(_regression(spark, sf_dir), -1.0)
