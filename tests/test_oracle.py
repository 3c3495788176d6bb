"""Every registered query against its SQL twin on the smallest data set."""

import pytest

from compare import compare, connect
from conftest import SF

from brierworks.plans.catalog import ORACLES, QUERIES

# fitted models have no SQL form; their parts are tested in test_learning.py
ROWS_ONLY = {"ml03_fit_bias_models", "ml04_tune_bias_models", "ml07_holdout_report", "ml07_holdout_bias"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_but_models_have_a_twin():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    status, info, _ = compare(spark, con, SF, name)
    # a sparse data set may leave a filtering query without rows; it must then be empty on both sides
    assert status in ("OK", "EMPTY"), info
    assert "TYPES" not in info, info
