"""Hand-computed small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from buildlens import schema
from buildlens.functions import columns as C
from buildlens.operators import balance as B
from buildlens.operators import encode as N
from buildlens.operators import evaluate as E
from buildlens.operators import history as H
from buildlens.operators import prepare as P
from buildlens.operators import profile as A
from buildlens.operators import rank as R
from buildlens.operators import sequences as S

T0 = dt.datetime(2024, 1, 1)


def builds(spark, values, project="p", label=None):
    """One row a day with a duration (and label) per value."""
    data = [(project, T0 + dt.timedelta(days=i), i + 1, 0, v, (label or [0] * 99)[i], 1.0)
            for i, v in enumerate(values)]
    return spark.createDataFrame(
        data, "gh_project_name string, gh_build_started_at timestamp, tr_build_id long, "
              "tr_job_id long, tr_duration double, build_failed int, "
              "gh_by_core_team_member double")


def column(df, name, key="tr_build_id"):
    return [r[name] for r in df.orderBy(key).select(name).collect()]


def test_schema_sizes():
    assert len(schema.CANONICAL) == 29
    assert [len(v) for v in schema.FEATURE_GROUPS.values()] == [4, 8, 9, 6, 2]
    assert len(schema.SCALED) == 34 and len(schema.ZERO_FILLED) == 16
    rules = [schema.BUILD_SUMS, schema.BUILD_MEANS, schema.BUILD_FIRSTS, schema.BUILD_MAXIMA]
    assert [len(r) for r in rules] == [16, 10, 7, 6]
    for dialect in schema.DIALECTS:
        header = [schema.source_name(dialect, c) for c in schema.CANONICAL]
        assert schema.match_dialect(header) == dialect
    assert schema.match_dialect(["a", "b"]) is None


def test_status_of_numbers_and_text(spark):
    numbers = spark.createDataFrame([(0,), (1,), (2,), (None,)], "s int")
    assert sorted(r[0] for r in P.status_to_label(numbers, "s").collect()) == [0, 1]
    text = spark.createDataFrame([("passed",), ("errored",), ("failed",), ("x",)], "s string")
    assert sorted(r[0] for r in P.status_to_label(text, "s").collect()) == [0, 1, 1]


def test_bool_text(spark):
    df = spark.createDataFrame([("True",), ("1.0",), ("False",), ("0.0",), (None,), ("x",)], "s string")
    got = [r[0] for r in df.select(C.bool_text(F.col("s"))).collect()]
    assert got == [1.0, 1.0, 0.0, 0.0, None, None]


@pytest.mark.parametrize("values, want", [
    ([None, 2.0, None, None, 8.0, None], [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]),
    ([None, None], [0.0, 0.0]),
    ([3.0], [3.0]),
])
def test_interpolation(spark, values, want):
    assert column(P.impute_interpolate(builds(spark, values)), "tr_duration") == want


def test_rows_without_a_project_are_counted_and_not_filled(spark):
    df = builds(spark, [1.0, None, 3.0]).withColumn("gh_project_name", F.lit(None).cast("string"))
    assert column(P.impute_interpolate(df), "tr_duration") == [1.0, None, 3.0]
    kept, missing = P.drop_unnamed(df)
    assert kept.count() == 0 and missing.first()[0] == 3


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame(
        [("p", 2.0), ("p", 1.0), ("p", None), ("q", None)], "gh_project_name string, c double")
    got = sorted((r[0], r[1]) for r in P.impute_mode(df, "c").collect())
    assert got == [("p", 1.0), ("p", 1.0), ("p", 2.0), ("q", 0.0)]


def test_history_of_first_rows_and_exclusion(spark):
    df = builds(spark, [1.0] * 4, label=[1, 0, 0, 1])
    assert column(H.elapsed_days_last_build(df), "elapsed_days_last_build") == [0.0, 1.0, 1.0, 1.0]
    assert column(H.prev_build_result(df), "prev_build_result") == [0.0, 1.0, 0.0, 0.0]
    assert column(H.same_committer(df), "same_committer") == [0, 1, 1, 1]
    assert column(H.proj_fail_rate_history(df), "proj_fail_rate_history") == pytest.approx(
        [1.0, 0.5, 1 / 3, 0.5])
    past = column(H.proj_fail_rate_history(df, exclude_current=True), "proj_fail_rate_history")
    assert past[0] is None and past[1:] == pytest.approx([1.0, 0.5, 1 / 3])


def test_null_committer_has_no_history(spark):
    df = builds(spark, [1.0, 1.0]).withColumn(
        "gh_by_core_team_member", F.lit(None).cast("double"))
    assert column(H.comm_avg_experience(df), "comm_avg_experience") == [None, None]
    assert column(H.comm_fail_rate_recent(df), "comm_fail_rate_recent") == [None, None]
    assert column(H.same_committer(df), "same_committer") == [0, 0]


def test_constant_columns(spark):
    df = builds(spark, [5.0, 5.0, None], label=[0, 1, 0])
    scaled, table = N.minmax_scale(df, ["tr_duration"])
    assert column(scaled, "tr_duration") == [0.0, 0.0, None]
    assert table.first()["tr_duration_max"] == 5.0
    assert A.label_correlation(df, ["tr_duration"]).first()["correlation"] is None


def test_conflicts_need_two_different_rows(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (2, "a"), (2, None), (3, "x")], "tr_build_id long, v string")
    got = A.conflicting_duplicates(df).select("tr_build_id").distinct().collect()
    assert [r[0] for r in got] == [2]


def test_first_value_skips_nulls_and_follows_job_order(spark):
    df = spark.createDataFrame(
        [("p", T0, 0, 1, 2, None), ("p", T0, 0, 1, 3, 7), ("p", T0, 0, 1, 4, 5)],
        "gh_project_name string, gh_build_started_at timestamp, build_failed int, "
        "tr_build_id long, tr_job_id long, day_week int")
    assert A.jobs_to_builds(df).first()["day_week"] == 7


def test_project_summary_rounding_and_filters(spark):
    df = builds(spark, [None, 1.0, 1.0], "a/b", [0, 1, 1]).union(
        builds(spark, [1.0] * 2, "c", [1, 1]))
    got = A.project_summary(df, min_rows=2, balance=0.7).collect()
    assert [(r["project"], r["num_rows"], r["passed_ratio"], r["failed_ratio"]) for r in got] == [
        ("a/b", 3, 0.3333, 0.6667)]
    assert got[0]["missing_ratio"] == round(1 / 21, 4)


@pytest.mark.parametrize("rows, folds", [(359, 0), (360, 1), (361, 1), (510, 2), (2000, 3)])
def test_fold_ends(spark, rows, folds):
    df = builds(spark, [1.0] * 0).union(spark.range(rows).select(
        F.lit("p"), F.timestamp_seconds(F.col("id")), "id", F.lit(0).cast("long"), F.lit(1.0),
        F.lit(0), F.lit(1.0)))
    got = S.online_folds(df, n_folds=3, window=300, step=150)
    sizes = {(r["fold"], r["split"]): (r["n"], r["lo"]) for r in got.groupBy("fold", "split").agg(
        F.count("*").alias("n"), F.min("position").alias("lo")).collect()}
    assert len(sizes) == 2 * folds
    for k in range(folds):
        assert sizes[k + 1, "train"] == (300, k * 150)
        assert sizes[k + 1, "test"] == (60, k * 150 + 300)


@pytest.mark.parametrize("n", [2, 3, 4, 6])
def test_window_counts_and_content(spark, n):
    df = builds(spark, [float(i) for i in range(n)], label=[i % 2 for i in range(n)])
    got = S.train_windows(df, ["tr_duration"], 3).orderBy("tr_build_id").collect()
    assert len(got) == max(n - 3, 0)
    for i, row in enumerate(got):
        assert row["window"] == [[float(j)] for j in range(i, i + 3)]
        assert row["build_failed"] == (i + 3) % 2


def test_short_test_windows_are_padded_on_the_left(spark):
    df = builds(spark, [1.0, 2.0, 3.0]).withColumn(
        "split", F.when(F.col("tr_build_id") == 1, "train").otherwise("test"))
    got = S.test_windows(df, ["tr_duration"], 3).orderBy("tr_build_id").collect()
    assert [r["window"] for r in got] == [[[0.0], [0.0], [1.0]], [[0.0], [1.0], [2.0]]]


def test_group_window_skips_absent_features(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0]],)], "w array<array<double>>")
    grid = S.group_window(F.col("w"), ["a", "b", "c"], {"g": ["c", "missing", "a"], "h": ["b"]})
    assert df.select(grid).first()[0] == [[[3.0, 1.0], [2.0, 0.0]]]


def scores(spark, pairs):
    return spark.createDataFrame([("p", 1, 1, y, p) for y, p in pairs],
                                 "proj string, exp int, iter int, y int, p double")


def test_areas_of_known_cases(spark):
    perfect = scores(spark, [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)])
    assert E.roc_auc(perfect).first()["AUC"] == 1.0
    assert E.average_precision(perfect).first()["PR_AUC"] == 1.0
    equal = scores(spark, [(1, 0.5), (0, 0.5), (0, 0.5), (0, 0.5)])
    assert E.roc_auc(equal).first()["AUC"] == 0.5
    assert E.average_precision(equal).first()["PR_AUC"] == 0.25
    one_class = scores(spark, [(0, 0.5), (0, 0.7)])
    assert E.roc_auc(one_class).first()["AUC"] is None


def test_area_identities(spark, sf_dir):
    from buildlens.plans import fixtures as X

    df = X.scores(spark, sf_dir)
    auc = {r["proj"]: r["AUC"] for r in E.roc_auc(df, ["proj"]).collect()}
    flipped = {r["proj"]: r["AUC"] for r in
               E.roc_auc(df.withColumn("p", -F.col("p")), ["proj"]).collect()}
    bent = {r["proj"]: r["AUC"] for r in
            E.roc_auc(df.withColumn("p", F.exp("p")), ["proj"]).collect()}
    for k in auc:
        assert flipped[k] == pytest.approx(1 - auc[k])
        assert bent[k] == pytest.approx(auc[k])


def test_threshold_rules(spark):
    df = scores(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)])
    assert E.best_threshold(df, "f1").first()["threshold"] == 0.7
    assert E.best_threshold(df, "recall", 0.5).first()["threshold"] == 0.9
    # no floor: the lowest threshold with full recall
    assert E.best_threshold(df, "recall").first()["threshold"] == 0.1
    assert E.best_threshold(df, "precision", 0.6).first()["threshold"] == 0.7
    assert E.best_threshold(df, "precision", 1.1).first()["threshold"] == 0.9
    with pytest.raises(ValueError):
        E.best_threshold(df, "speed")


def test_entries_with_given_threshold_match_confusion(spark, sf_dir):
    from buildlens.plans import fixtures as X

    df = X.scores(spark, sf_dir)
    keys = df.select(*E.KEYS).distinct().withColumn("threshold", F.lit(0.333))
    a = E.metric_entries(df, thresholds=keys).select(*E.KEYS, "accuracy", "precision", "recall", "F1")
    b = E.confusion_metrics(df, 0.333).select(*E.KEYS, "accuracy", "precision", "recall", "F1")
    for left, right in zip(sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))):
        assert left[:3] == right[:3] and left[3:] == pytest.approx(right[3:])


def test_gate_and_weighted_score(spark):
    good = dict(F1=0.8, AUC=0.8, accuracy=0.8, recall=0.8, precision=0.8, PR_AUC=0.8)
    cases = [good, {**good, "AUC": 0.995}, {**good, "recall": 0.65}, {**good, "F1": None}]
    df = spark.createDataFrame(
        [(i, *[float(c[m]) if c[m] is not None else None for m in schema.METRICS])
         for i, c in enumerate(cases)], "i int, " + ", ".join(f"{m} double" for m in schema.METRICS))
    assert sorted(r["i"] for r in E.metric_gate(df).collect()) == [0, 2, 3]
    score = {r["i"]: r["score"] for r in E.weighted_score(df).collect()}
    assert score[0] == pytest.approx(0.8) and score[1] == score[2] == -1.0
    assert score[3] == pytest.approx(0.6)


def test_bellwether_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.5, 0.1), ("a", 0.5, 0.2)], "proj string, F1 double, PR_AUC double")
    assert R.bellwether(df).first()["proj"] == "a"


def test_standard_scale_passes_flags_through(spark):
    df = spark.createDataFrame([(1.0, 0, 3.0, 0.5), (3.0, 1, 3.0, 0.25)],
                               "x double, flag int, const double, kind_a double")
    scaled, scale = N.standard_scale(df, df.columns, ["kind_"])
    assert scale.scaled == ["x", "const"] and scale.untouched == ["kind_a", "flag"]
    got = sorted(map(tuple, scaled.select("x", "const", "flag", "kind_a").collect()))
    assert got == [(-1.0, 0.0, 0, 0.5), (1.0, 0.0, 1, 0.25)]


# -- balancing ----------------------------------------------------------------
def vectors(spark, ones, zeros):
    data = [("p", i, [float(i), float(i % 3)], 1) for i in range(ones)]
    data += [("p", 1000 + i, [float(-i), 9.0], 0) for i in range(zeros)]
    return spark.createDataFrame(data, "k string, i long, v array<double>, build_failed int")


@pytest.mark.parametrize("block", [2000, 7])
def test_neighbours_against_brute_force(spark, block):
    df = B.minority_knn(vectors(spark, 20, 40), ["k"], "v", "i", block=block)
    points = {i: (float(i), float(i % 3)) for i in range(20)}
    assert df.count() == 20
    for row in df.collect():
        me = points[row["id"]]
        ranked = sorted(
            ((sum((a - b) ** 2 for a, b in zip(me, p)) ** 0.5, i)
             for i, p in points.items() if i != row["id"]))[:5]
        assert [n["neighbour"] for n in row["neighbours"]] == [i for _, i in ranked]


def test_smote_reaches_parity_between_neighbours(spark):
    df = B.smote_balance(vectors(spark, 6, 20), ["k"], "v", "i").persist()
    sizes = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 20, 1: 20}
    made = df.filter("synthetic > 0").collect()
    assert len(made) == 14 and all(r["label"] == 1 for r in made)
    assert all(0 <= r["vector"][0] <= 5 and 0 <= r["vector"][1] <= 2 for r in made)
    again = B.smote_balance(vectors(spark, 6, 20).repartition(3), ["k"], "v", "i")
    assert sorted(map(str, df.collect())) == sorted(map(str, again.collect()))


@pytest.mark.parametrize("ones, zeros, total", [(0, 5, 5), (5, 5, 10), (1, 4, 8)])
def test_smote_edge_sizes(spark, ones, zeros, total):
    assert B.smote_balance(vectors(spark, ones, zeros), ["k"], "v", "i").count() == total


def test_short_keys_are_padded_before_balancing(spark):
    df = vectors(spark, 2, 1).withColumn("i", F.when(F.col("i") < 1000, F.col("i") + 1).otherwise(3))
    padded = B.pad_short(df, ["k"], "v", "i", "build_failed", 8)
    assert padded.count() == 8
    assert padded.filter("i <= 0 AND build_failed = 0 AND v = array(0D, 0D)").count() == 5
    # 6 passed to 2 failed: 4 synthetic rows, and 12 - 8 windows
    assert B.smote_windows(df, ["k"], "v", "i", 8).count() == 4


def test_unusable_scores_count_for_no_measure(spark):
    from buildlens.operators import evaluate

    nan = float("nan")
    good = [("a", 1, 1, 1, 0.9), ("a", 1, 1, 0, 0.1), ("a", 1, 1, 0, 0.7)]
    bad = [("a", 1, 1, 0, None), ("a", 1, 1, 0, nan), ("a", 1, 1, 1, nan), ("a", 1, 1, None, 0.8),
           (None, 1, 1, 1, 0.4), ("b", 1, 1, 0, None), ("c", None, 1, 1, 0.2)]
    schema = "proj string, exp int, iter int, y int, p double"
    some, every = (spark.createDataFrame(rows, schema) for rows in (good, good + bad))
    for measure in (evaluate.pr_curve, evaluate.roc_curve, evaluate.best_threshold, evaluate.roc_auc,
                    evaluate.average_precision, evaluate.pr_auc_trapezoid, evaluate.confusion_metrics,
                    evaluate.metric_entries):
        assert sorted(map(repr, measure(every).collect())) == sorted(map(repr, measure(some).collect()))
