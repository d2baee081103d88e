"""Every catalogue query gives the rows of its SQL."""

from __future__ import annotations

import pytest

from quarry.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_agree(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
