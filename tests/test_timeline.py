"""Sliced computations equal plain windows, on awkward small tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from buildlens.operators.timeline import SLICE, Timeline, exact_quantiles

SCHEMA = "k string, t long, i long, v double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    # one key with most rows, one time stamp with most of that key's rows,
    # small keys, a key of nulls only, and rows without a key
    data = [("hot", 5 if n % 3 else n, n, rng.random() if n % 4 else None) for n in range(900)]
    data += [("mid", n, n, float(n % 3)) for n in range(150)]
    data += [("one", 1, 1, 2.0), ("none", 1, 1, None), ("none", 2, 2, None)]
    data += [(None, n, n, 1.0) for n in range(20)]
    rng.shuffle(data)
    return spark.createDataFrame(data, SCHEMA).repartition(5).persist()


def ordered(df, name="x"):
    return {(r["k"], r["i"]): r[name] for r in df.collect()}


def plain(frame=None):
    w = Window.partitionBy("k").orderBy("t", "i")
    return w.rowsBetween(*frame) if frame else w


def known(value):
    return F.when(F.col("k").isNotNull(), value)


CASES = {
    "running": (
        lambda line: line.running({"x": F.col("v")}),
        lambda: known(F.sum("v").over(plain((Window.unboundedPreceding, 0))))),
    "running_before": (
        lambda line: line.running({"x": F.col("v")}, exclude_current=True),
        lambda: known(F.sum("v").over(plain((Window.unboundedPreceding, -1))))),
    "position": (
        lambda line: line.position("x"),
        lambda: known(F.row_number().over(plain()))),
    "previous": (
        lambda line: line.previous({"x": F.col("v")}),
        lambda: known(F.lag("v").over(plain()))),
    "recent_mean": (
        lambda line: line.recent_mean("x", F.col("v"), 10),
        lambda: known(F.avg("v").over(plain((-9, 0))))),
    "recent_mean_before": (
        lambda line: line.recent_mean("x", F.col("v"), 10, exclude_current=True),
        lambda: known(F.avg("v").over(plain((-10, -1))))),
    "history": (
        lambda line: line.history("x", F.coalesce("v", F.lit(-1.0)), 200),
        lambda: known(F.collect_list(F.coalesce("v", F.lit(-1.0))).over(plain((-200, -1))))),
}


@pytest.mark.parametrize("hot_rows", [10_000, 140])
@pytest.mark.parametrize("name", CASES)
def test_equals_plain_window(rows, name, hot_rows):
    run, expected = CASES[name]
    line = Timeline.of(rows, ["k"], ["t", "i"], hot_rows)
    assert line.split == (hot_rows < 900)
    got, want = ordered(run(line).frame()), ordered(rows.withColumn("x", expected()))
    assert got.keys() == want.keys()
    for key, value in want.items():
        if key[0] is None:
            continue
        assert got[key] == (pytest.approx(value) if value is not None else None), key


def test_slices_are_small_ordered_and_never_tiny(rows):
    line = Timeline.of(rows, ["k"], ["t", "i"], 140)
    spans = line.rows.filter("k = 'hot'").groupBy(SLICE).agg(
        F.count("*").alias("n"), F.min(F.struct("t", "i")).alias("lo"),
        F.max(F.struct("t", "i")).alias("hi")).orderBy(SLICE).collect()
    assert len(spans) > 3
    assert max(s["n"] for s in spans) <= 300
    # every slice but the first is long enough to hand 128 rows to the next
    assert min(s["n"] for s in spans[1:-1]) >= 128
    assert all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))


def test_nearest_known_both_ways(rows):
    for hot_rows in (10_000, 140):
        line = Timeline.of(rows, ["k"], ["t", "i"], hot_rows)
        df = line.nearest_known("x", "y", F.col("v")).frame()
        w = plain()
        want = rows.withColumn(
            "x", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        ).withColumn("y", F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
        for name in ("x", "y"):
            got, expected = ordered(df, name), ordered(want, name)
            assert {k: v for k, v in got.items() if k[0]} == {
                k: v for k, v in expected.items() if k[0]}


@pytest.mark.parametrize("hot_rows", [10_000, 140])
def test_head_keeps_the_first_rows(rows, hot_rows):
    df = Timeline.of(rows, ["k"], ["t", "i"], hot_rows).head("x", 200).frame()
    counts = {r["k"]: r["n"] for r in
              df.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert counts == {"hot": 200, "mid": 150, "one": 1, "none": 2}
    want = ordered(rows.withColumn("x", F.row_number().over(plain())))
    assert all(want[k] == v for k, v in ordered(df).items() if k[0])


@pytest.mark.parametrize("hot_rows", [10_000, 140])
def test_exact_quantiles(rows, hot_rows):
    got = {r["k"]: (r["a"], r["b"]) for r in exact_quantiles(
        rows.filter("k IS NOT NULL"), ["k"], "v", [0.5, 0.9], ["a", "b"], hot_rows).collect()}
    want = {r["k"]: r["q"] for r in rows.filter("k IS NOT NULL AND v IS NOT NULL").groupBy("k").agg(
        F.percentile("v", F.array(F.lit(0.5), F.lit(0.9))).alias("q")).collect()}
    assert got.keys() == want.keys() == {"hot", "mid", "one"}
    for k, q in want.items():
        assert got[k] == pytest.approx(tuple(q))


def test_results_do_not_depend_on_partitioning(rows):
    def run(df):
        line = Timeline.of(df, ["k"], ["t", "i"], 140).recent_mean("x", F.col("v"), 10)
        return ordered(line.frame())

    a, b = run(rows), run(rows.repartition(13))
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k]) if a[k] is not None else b[k] is None for k in a)
