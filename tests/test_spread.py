"""Joined jobs lie in as many tasks as their rows need."""

import pytest
from pyspark.sql import functions as F

from buildlens.operators import history as H
from buildlens.operators import profile as A
from buildlens.plans import fixtures as X


@pytest.fixture
def shuffled(spark):
    """Joins as on large tables, of which none is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("operator", [
    H.num_distinct_authors,
    lambda df: A.distinct_rows(df.select("tr_build_id", "gh_project_name", "gh_is_pr"))])
def test_tasks_on_jobs_grow_with_the_rows(spark, sf_dir, shuffled, monkeypatch, operator):
    before = operator(X.jobs(spark, sf_dir))
    # as if the table were large: more tasks than the session's 8 partitions
    monkeypatch.setattr(X, "ROWS_PER_TASK", 2_000)
    after = operator(X.jobs(spark, sf_dir))
    wanted = -(-X.table(spark, sf_dir, "lineitem").count() // 2_000)
    assert wanted > 8
    sizes = after.groupBy(F.spark_partition_id()).count().collect()
    assert after.rdd.getNumPartitions() == wanted
    assert max(r["count"] for r in sizes) < 2 * 2_000
    assert after.count() == before.count() and after.exceptAll(before).isEmpty()
