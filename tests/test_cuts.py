"""The slice a row belongs to equals the count of cuts at or before it."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from buildlens.operators.cuts import FEW, lookup

MARK = "_c_"


def counted(rows, cuts, order):
    """The count by comparing every row with every cut of its key."""
    # unmatched rows and null keys count nothing
    c = cuts.select(F.col("k").alias("ck"), F.struct(*order).alias("cut"))
    pairs = rows.join(c, (F.col("k") == F.col("ck")) & (F.col("cut") <= F.struct(*order)), "left")
    return {r["i"]: r["n"] for r in pairs.groupBy("i").agg(F.count("cut").alias("n")).collect()}


def tree_of(rows, order, every=3):
    """A cut at every third different row of the keys but 'none'."""
    nth = F.row_number().over(Window.partitionBy("k").orderBy(*order))
    cuts = rows.filter("k <> 'none'").select("k", *order).distinct().withColumn("_n", nth)
    cuts = cuts.filter(F.col("_n") % every == 0).withColumn(f"{MARK}no", (F.col("_n") / every).cast("int"))
    return cuts.drop("_n").persist()


def check(rows, order):
    cuts = tree_of(rows, order)
    found = lookup(cuts, ["k"], order, MARK)
    got = found.slice_of(rows, "_slice")
    assert got.columns == [*rows.columns, "_slice"]
    assert {r["i"]: r["_slice"] for r in got.collect()} == counted(rows, cuts, order)
    return found, got


def value_of(kind, rng, n):
    at = dt.datetime(2024, 1, 1)
    if n % 11 == 0:
        return None
    return {
        # far outliers, one value with most of the rows, neighbours one step apart
        "timestamp": lambda: dt.datetime(1971, 1, 1) if n % 50 == 1 else at if n % 3 else at + dt.timedelta(
            microseconds=rng.randrange(400)),
        "date": lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(200)),
        "long": lambda: rng.choice([-2**63, 2**63 - 1, 0, rng.randrange(300), 2**62 + rng.randrange(50)]),
        "double": lambda: rng.choice([float("nan"), float("inf"), -1e300, -0.0, 1e-9 * rng.random(), rng.random()]),
        "string": lambda: rng.choice(["", "same long beginning " * 2 + str(rng.randrange(90)), chr(rng.randrange(40, 9000))]),
        "boolean": lambda: rng.random() < 0.5,
        "decimal(20,4)": lambda: Decimal(rng.randrange(-10**9, 10**9)) / 10000,
    }[kind]()


@pytest.mark.parametrize("kinds", [
    ("timestamp", "long"), ("double", "date", "long"), ("string", "long"), ("boolean", "decimal(20,4)", "string")])
def test_equals_comparing_with_every_cut(spark, kinds):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "hot", "small", "none", None]), n, *[value_of(kind, rng, n + j) for j, kind in
             enumerate(kinds)]) for n in range(1500)]
    order = [f"o{j}" for j in range(len(kinds))]
    schema = "k string, i long, " + ", ".join(f"{o} {kind}" for o, kind in zip(order, kinds, strict=True))
    check(spark.createDataFrame(data, schema), order)


def test_parts_stay_small_with_ties_and_outliers(spark):
    # almost all rows of one time, some far before and after it
    data = [("hot", n, 1_000_000 if n % 20 else n * 10**9) for n in range(3000)]
    rows = spark.createDataFrame(data, "k string, i long, t long")
    found, _ = check(rows, ["t", "i"])
    assert 0 < len(found.steps) <= 3
    widest = found.intervals.groupBy("k", f"{MARK}path", f"{MARK}part").count().agg(F.max("count")).first()[0]
    assert widest <= FEW + 1
    # the tables grow with the cuts alone
    assert found.intervals.count() <= 5 * 1000


def test_rows_carry_no_array_and_the_lookup_is_generated_code(spark):
    rows = spark.createDataFrame([("hot", n, n // 7) for n in range(600)], "k string, i long, t long").repartition(2)
    found, got = check(rows, ["t", "i"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert "lambda" not in plan and "array<" not in plan
    generated = got._jdf.queryExecution().executedPlan()
    text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(generated)
    # all joins of a row are in one piece of generated code
    assert any(piece.count("BroadcastHashJoin") >= len(found.steps) + 2 for piece in text.split("Generated code:"))


def test_no_cut_at_all(spark):
    rows = spark.createDataFrame([("a", 1, 1), (None, 2, 2)], "k string, i long, t long")
    cuts = rows.select("k", "t", F.lit(1).alias(f"{MARK}no")).limit(0)
    assert {r["_slice"] for r in lookup(cuts, ["k"], ["t"], MARK).slice_of(rows, "_slice").collect()} == {0}
