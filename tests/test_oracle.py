"""Every query with an SQL twin gives the same names, types and rows as it."""

import pytest

from prospectra.oracle import ORACLE_SQL
from prospectra.queries import QUERIES
from tests.compare import duck, mismatch


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, con, name):
    assert mismatch(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) is None


# Values of models that Spark's own solvers fit; README names them.
ROWS_ONLY = {"model_metrics", "chosen_model", "chosen_model_scores", "chosen_model_report", "logistic_coefficients",
             "logistic_top_coefficients", "exact_coefficients", "fitted_drivers", "cv_metrics", "cv_means"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - ROWS_ONLY == set(ORACLE_SQL) and ROWS_ONLY <= set(QUERIES)
