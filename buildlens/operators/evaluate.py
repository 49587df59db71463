"""Scores against labels: curves, thresholds, areas and error measures.

Rows are first collapsed to one per distinct score and key (combined on the
map side). Everything else follows from running counts in descending score
order, so equal scores are handled together, as the usual definitions ask.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import METRICS, SCORE_WEIGHTS
from .timeline import Timeline, any_hot, exact_quantiles

KEYS = ["proj", "exp", "iter"]
_TINY = 1e-10  # fixed value: keeps F1 defined where precision and recall are 0


def usable(df: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """The rows that take part in every measure here: a null key, a null label or a
    null or NaN score counts for none of them."""
    for needed in [*keys, "p", "y"]:
        df = df.filter(F.col(needed).isNotNull())
    return df.filter(~F.isnan("p"))


def sweep(df: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """One row per key and distinct score: counts at the score, counts at or
    above it (``tp``, ``seen``) and key totals (``pos_all``, ``n_all``).

    Only ``usable`` rows take part."""
    keys = list(keys)
    df = usable(df, keys)
    groups = df.groupBy(*keys, "p").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
    if not any_hot(df, keys):
        # few enough scores per key for one task: totals share the sort's exchange
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
        return groups.select(
            "*", F.sum("pos").over(upto).alias("tp"), F.sum("n").over(upto).alias("seen"),
            F.sum("pos").over(whole).alias("pos_all"), F.sum("n").over(whole).alias("n_all"))
    at = keys or ["_all"]
    if not keys:
        groups = groups.withColumn("_all", F.lit(1))
    totals = groups.groupBy(*at).agg(F.sum("pos").alias("pos_all"), F.sum("n").alias("n_all"))
    line = Timeline.of(groups.withColumn("_down", -F.col("p")), at, ["_down"])
    line = line.running({"tp": F.col("pos"), "seen": F.col("n")})
    return line.frame().join(totals, at).drop("_down", *([] if keys else ["_all"]))


def _precision() -> Column:
    return F.col("tp") / F.col("seen")


def _recall() -> Column:
    # without positives every threshold finds all of them
    return F.when(F.col("pos_all") > 0, F.try_divide(F.col("tp"), F.col("pos_all"))).otherwise(1.0)


def _f1() -> Column:
    p, r = _precision(), _recall()
    return 2 * (p * r) / (p + r + F.lit(_TINY))


def pr_curve(df: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """Precision and recall per threshold, and the end point (1, 0) without one."""
    keys = list(keys)
    points = sweep(df, keys).select(
        *keys, F.col("p").alias("threshold"), _precision().alias("precision"),
        _recall().alias("recall"))
    ends = usable(df, keys).select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.union(ends)


def best_threshold(
    df: DataFrame, priority: str = "f1", floor: float | None = None,
    keys: Iterable[str] = KEYS,
) -> DataFrame:
    """The threshold that is best by F1, by recall or by precision.

    ``floor`` is the least value of the priority metric: among thresholds that
    reach it the other metric decides, and if none does the priority metric.
    Ties take the lowest threshold. The curve's end point has no threshold and
    takes no part.
    """
    keys = list(keys)
    swept = sweep(df, keys)
    precision, recall = _precision(), _recall()
    if priority == "f1":
        rank = [_f1()]
    elif priority in ("recall", "precision"):
        main, other = (recall, precision) if priority == "recall" else (precision, recall)
        enough = F.lit(False) if floor is None else main >= F.lit(float(floor))
        rank = [enough, F.when(enough, other).otherwise(main)]
    else:
        raise ValueError("priority must be 'f1', 'recall' or 'precision'")
    point = F.struct(F.col("p").alias("threshold"), precision.alias("precision"),
                     recall.alias("recall"), _f1().alias("F1"))
    best = F.max_by(point, F.struct(*rank, -F.col("p"))).alias("_best")
    return swept.groupBy(*keys).agg(best).select(*keys, "_best.*")


def roc_curve(df: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """False and true positive rate per threshold, from (0, 0); null rates when
    a class is absent."""
    keys = list(keys)
    fp, neg = F.col("seen") - F.col("tp"), F.col("n_all") - F.col("pos_all")
    points = sweep(df, keys).select(
        *keys, F.col("p").alias("threshold"), F.try_divide(fp, neg).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("pos_all")).alias("tpr"))
    start = usable(df, keys).select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"))
    return points.union(start)


def _auc() -> Column:
    """Share of (negative, positive) pairs ordered right, ties count half."""
    neg = F.col("n") - F.col("pos")
    above = F.col("tp") - F.col("pos")
    pairs = F.max("pos_all").cast("double") * (F.max("n_all") - F.max("pos_all"))
    return F.try_divide(F.sum(neg * above + neg * F.col("pos") / F.lit(2.0)), pairs)


def _ap() -> Column:
    return F.try_divide(F.sum(F.col("pos") * _precision()), F.max("pos_all"))


def _trapezoid() -> Column:
    """Area under the precision/recall points with recall on the x axis."""
    seen_before = F.col("seen") - F.col("n")
    before = F.coalesce(
        F.try_divide(F.col("tp") - F.col("pos"), seen_before), F.lit(1.0))
    return F.try_divide(F.sum(F.col("pos") * (_precision() + before) / 2), F.max("pos_all"))


def _area(df: DataFrame, keys: Iterable[str], area: Column, name: str) -> DataFrame:
    return sweep(df, keys).groupBy(*keys).agg(area.alias(name))


def roc_auc(df: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    return _area(df, list(keys), _auc(), "AUC")


def average_precision(df: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    return _area(df, list(keys), _ap(), "PR_AUC")


def pr_auc_trapezoid(df: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    return _area(df, list(keys), _trapezoid(), "PR_AUC")


def _confusion(tp: Column, fp: Column, fn: Column, n: Column) -> list[Column]:
    return [
        C.safe_ratio(n - fp - fn, n).alias("accuracy"),
        C.safe_ratio(tp, tp + fp).alias("precision"),
        C.safe_ratio(tp, tp + fn).alias("recall"),
        C.safe_ratio(2 * tp, 2 * tp + fp + fn).alias("F1"),
    ]


def confusion_metrics(
    df: DataFrame, threshold: float | Column = 0.5, keys: Iterable[str] = KEYS
) -> DataFrame:
    """Accuracy, precision, recall and F1 of the usable rows; 0 where undefined."""
    keys = list(keys)
    df = usable(df, keys)
    said, y = C.to_label(F.col("p"), threshold), F.col("y")
    counts = df.groupBy(*keys).agg(
        F.count_if((said == 1) & (y == 1)).alias("_tp"),
        F.count_if((said == 1) & (y == 0)).alias("_fp"),
        F.count_if((said == 0) & (y == 1)).alias("_fn"),
        F.count(F.lit(1)).alias("_n"),
    )
    tp, fp, fn, n = (F.col(c) for c in ("_tp", "_fp", "_fn", "_n"))
    return counts.select(*keys, *_confusion(tp, fp, fn, n))


def metric_entries(
    df: DataFrame, keys: Iterable[str] = KEYS, pr_area: str = "average",
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """One metric entry per key: areas, threshold and the metrics at it.

    The threshold is the best one by F1 on these rows, or comes from
    ``thresholds`` (keys, threshold). With the former, the counts at the
    threshold are a row of the sweep, so one pass gives everything.
    """
    keys = list(keys)
    swept = sweep(df, keys)
    area = _ap() if pr_area == "average" else _trapezoid()
    at = F.struct("tp", "seen", "pos_all", "n_all", F.col("p").alias("threshold"))
    if thresholds is None:
        pick = F.max_by(at, F.struct(_f1(), -F.col("p")))
    else:
        swept = swept.join(
            thresholds.select(*keys, F.col("threshold").alias("_given")), keys, "left")
        # counts at the lowest score that still reaches the threshold
        reached = F.col("p") >= F.col("_given")
        pick = F.min_by(at, F.when(reached, F.col("p")))
    found = swept.groupBy(*keys).agg(
        _auc().alias("AUC"), area.alias("PR_AUC"), pick.alias("_at"),
        F.max("pos_all").alias("_pos"), F.max("n_all").alias("_n"),
        *([] if thresholds is None else [F.max("_given").alias("_given")]),
    )
    tp = F.coalesce(F.col("_at.tp"), F.lit(0))
    seen = F.coalesce(F.col("_at.seen"), F.lit(0))
    fp, fn = seen - tp, F.col("_pos") - tp
    threshold = F.col("_at.threshold") if thresholds is None else F.col("_given")
    return found.select(
        *keys, "AUC", "PR_AUC", *_confusion(tp, fp, fn, F.col("_n")),
        threshold.alias("threshold"))


# -- gates and scores on entries ----------------------------------------------
def metric_gate(
    entries: DataFrame, limit: float = 0.99, metrics: Iterable[str] = METRICS
) -> DataFrame:
    """Drop entries with a metric that is too good to be true."""
    worst = F.greatest(*[F.coalesce(F.col(m), F.lit(0.0)) for m in metrics])
    return entries.filter(worst <= F.lit(limit))


def weighted_score(
    entries: DataFrame, weights: dict[str, float] | None = None, upper: float = 0.99,
    lower: float = 0.7,
) -> DataFrame:
    """Weighted sum of the metrics, or -1 if one is out of [lower, upper).

    A column the entries lack counts as 0; a null value is skipped.
    """
    weights = SCORE_WEIGHTS if weights is None else weights

    def value(m: str) -> Column:
        return F.col(m) if m in entries.columns else F.lit(0.0)

    outside = F.lit(False)
    for m in METRICS:
        bad = (value(m) >= upper) | (value(m) < lower)
        outside = outside | F.coalesce(bad, F.lit(False))
    total = F.lit(0.0)
    for m, weight in weights.items():
        total = total + F.coalesce(value(m) * weight, F.lit(0.0))
    return entries.withColumn("score", F.when(outside, F.lit(-1.0)).otherwise(total))


# -- regression ---------------------------------------------------------------
def _restore(value: Column) -> Column:
    low, high = F.col("low"), F.col("high")
    return value * F.when(high > low, high - low).otherwise(F.lit(1.0)) + low


def _fit(y: Column, p: Column, name: str) -> list[Column]:
    error = y - p
    return [
        F.avg(error * error).alias(f"_mse{name}"),
        F.avg(F.abs(error)).alias(f"_mae{name}"),
        F.sum(error * error).alias(f"_sse{name}"),
        (F.var_pop(y) * F.count(y)).alias(f"_sst{name}"),
    ]


def _r2(name: str) -> Column:
    sse, sst = F.col(f"_sse{name}"), F.col(f"_sst{name}")
    constant = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(sst > 0, 1 - F.try_divide(sse, sst)).otherwise(constant)


def _original(df: DataFrame) -> DataFrame:
    clipped = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0 - 1e-6))
    return df.withColumns({"_y": _restore(F.col("y")), "_p": _restore(clipped)})


def regression_scorecard(df: DataFrame) -> DataFrame:
    """Error measures of scaled predictions (target, y, p, low, high).

    ``low`` and ``high`` are the bounds the target was scaled with. Measures
    are per target and then averaged over targets.
    """
    rows = _original(df).withColumn("_err", F.abs(F.col("_y") - F.col("_p")))
    per_target = rows.groupBy("target").agg(
        *_fit(F.col("_y"), F.col("_p"), ""), *_fit(F.col("y"), F.col("p"), "_norm"))
    medians = exact_quantiles(rows, ["target"], "_err", [0.5], ["_medae"])
    return per_target.join(medians, "target").agg(
        F.avg("_mse").alias("MSE"), F.avg("_mae").alias("MAE"), F.avg(_r2("")).alias("R2"),
        F.avg("_medae").alias("MedAE"), F.avg("_mse_norm").alias("MSE_norm"),
        F.avg("_mae_norm").alias("MAE_norm"), F.avg(_r2("_norm")).alias("R2_norm"),
    )


def target_r2(df: DataFrame) -> DataFrame:
    rows = _original(df)
    return rows.groupBy("target").agg(*_fit(F.col("_y"), F.col("_p"), "")).select(
        "target", _r2("").alias("R2"))


def low_r2_features(df: DataFrame, limit: float = -0.1) -> DataFrame:
    """Features behind the targets (``side_i:feature``) that are predicted badly."""
    feature = F.element_at(F.split("target", ":"), 2)
    return (
        target_r2(df).filter(F.col("R2") < limit).select(feature.alias("feature")).distinct()
    )
