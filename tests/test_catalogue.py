"""Every query against its DuckDB check, and the large-key paths once more."""

import oracle
import pytest

from buildlens.plans.catalogue import ORACLES, QUERIES

# queries whose results depend on slicing a key's order
SLICED = [
    "proj_fail_rate_recent", "proj_fail_rate_history", "comm_fail_rate_recent",
    "prev_build_result", "impute_interpolate", "impute_median", "train_windows",
    "online_folds", "pr_auc_trapezoid", "label_dictionary",
]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    got = oracle.rows_of_spark(QUERIES[name](spark, sf_dir))
    assert oracle.difference(got, oracle.rows_of_duckdb(duck, ORACLES[name])) is None


@pytest.mark.parametrize("name", SLICED)
def test_matches_sql_when_keys_are_large(spark, duck, sf_dir, sliced, name):
    got = oracle.rows_of_spark(QUERIES[name](spark, sf_dir))
    assert oracle.difference(got, oracle.rows_of_duckdb(duck, ORACLES[name])) is None


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
