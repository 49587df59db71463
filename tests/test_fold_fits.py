"""Fits inside a fold: the solver against Spark ML, views and synthetic rows."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from buildlens.operators import fold_fits as FF
from buildlens.operators import modeling as M
from buildlens.plans import fixtures as X

FEATURES = ["gh_diff_files_added", "gh_sloc", "tr_duration", "build_failed"]


def _fold(n=260, width=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * [1, 10, 0.1, 5, 1]
    odds = np.roll(x[:, 0], 1) - 1 + 0.2 * np.roll(x[:, 1], 2) / 10
    return x, (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(float)


@pytest.mark.parametrize("length,penalty", [(3, 0.05), (60, 0.01), (60, 0.1)])
def test_fit_equals_spark_ml(spark, length, penalty):
    x, y = _fold()
    train = np.arange(len(x)) < 200
    got = dict((part, (labels, p)) for part, labels, p in
               FF.FoldFits(x, y, train, FF.WEIGHTS, 1).score(length, penalty, 60))
    assert set(got) == {"train", "validation", "test"}
    views = FF.fold_views(x, length)
    fitted = len(got["train"][0])
    at = np.arange(length, length + fitted)
    ones = y[at].sum()
    rows = spark.createDataFrame(
        [(Vectors.dense(views[i]), float(y[i]),
          0.5 / float(ones if y[i] else fitted - ones)) for i in at], ["features", "label", "w"])
    model = LogisticRegression(weightCol="w", regParam=penalty, maxIter=1000, tol=1e-12).fit(rows)
    everything = spark.createDataFrame(
        [(i, Vectors.dense(views[i])) for i in range(200, 260)], ["i", "features"])
    expected = [r["probability"][1] for r in model.transform(everything).orderBy("i").collect()]
    assert np.abs(np.array(expected) - got["test"][1]).max() < 1e-3


def test_views_are_the_rows_before_each_row():
    x = np.arange(1.0, 13.0).reshape(6, 2)
    views = FF.fold_views(x, 2)
    assert views[0].tolist() == [0, 0, 0, 0] and views[1].tolist() == [0, 0, 1, 2]
    assert views[4].tolist() == [5, 6, 7, 8]


def test_synthetic_rows_lie_between_rows_of_the_smaller_class():
    x, y = _fold(120)
    y = (np.arange(120) % 6 == 0).astype(int)
    more, labels = FF.synthetic_rows(x, y, 7)
    assert len(more) == 80 and set(labels) == {1}
    small = x[y == 1]
    assert (more >= small.min(axis=0) - 1e-9).all() and (more <= small.max(axis=0) + 1e-9).all()
    assert np.array_equal(more, FF.synthetic_rows(x, y, 7)[0])
    # one class, equal classes, a class of one row
    assert len(FF.synthetic_rows(x, np.ones(120, int), 7)[0]) == 0
    assert len(FF.synthetic_rows(x, np.arange(120) % 2, 7)[0]) == 0
    alone, _ = FF.synthetic_rows(x, (np.arange(120) == 5).astype(int), 7)
    assert len(alone) == 118 and (alone == x[5]).all()


def test_held_out_rows_change_no_fit():
    x, y = _fold()
    train = np.arange(len(x)) < 200
    changed = x.copy()
    changed[180:] = 99.0
    for balance in FF.BALANCES:
        a, b = (dict((part, p) for part, _, p in FF.FoldFits(v, y, train, balance, 1).score(4, 0.1, 40))
                for v in (x, changed))
        assert np.allclose(a["train"], b["train"])


def test_odd_folds():
    x, y = _fold(60)
    train = np.arange(60) < 50
    # one class, missing labels, values that are no numbers, windows longer than the fold
    one = FF.FoldFits(x, np.ones(60), train, FF.WEIGHTS, 1).score(3, 0.0, 40)
    assert all((p > 0.99).all() for _, _, p in one)
    unknown = np.where(np.arange(60) % 7 == 0, np.nan, y)
    parts = dict((n, labels) for n, labels, _ in
                 FF.FoldFits(x, unknown, train, FF.BEFORE_WINDOW, 1).score(3, 0.01, 40))
    assert sum(map(len, parts.values())) == sum(~np.isnan(unknown[3:]))
    x[5] = np.nan
    x[6] = np.inf
    assert all(np.isfinite(p).all() for _, _, p in
               FF.FoldFits(x, y, train, FF.NONE, 1).score(3, 0.0, 40))
    assert FF.FoldFits(x, y, train, FF.WEIGHTS, 1).score(55, 0.1, 40) == []


def test_unknown_balance_is_an_error(spark, sf_dir):
    rows = M.fold_rows(X.labelled(spark, sf_dir), FEATURES, 1, 300, 150)
    with pytest.raises(ValueError):
        FF.score_folds(rows, M.candidate_table(spark, []), "smote")


def test_rebalancing_is_used_by_the_online_validation(spark, sf_dir):
    rows = X.labelled(spark, sf_dir).filter(F.col("build_failed").isNotNull())
    options = dict(top=1, n_folds=1, window=300, step=150, repeats=2,
                   space={"time_step": [8], "reg_param": [0.01], "max_iter": [40]})
    results = {b: M.online_validation(rows, FEATURES, "random", balance=b, **options)
               for b in (FF.WEIGHTS, FF.BEFORE_WINDOW)}
    tried = {b: [(c["iter"], c["score"], c["loss"]) for c in r.candidates.orderBy("iter").collect()]
             for b, r in results.items()}
    assert tried[FF.WEIGHTS] != tried[FF.BEFORE_WINDOW]
    # equal candidates of two repeats
    assert all(t[0][1:] == t[1][1:] for t in tried.values())
