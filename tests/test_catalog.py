"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF_DIR

import __spark_entry__ as contract
from tools import check_catalog


@pytest.fixture(scope="module")
def twin_db():
    return check_catalog.connect(SF_DIR)


def test_entry(spark):
    assert contract.entry(spark).columns == ["_id_x", "id", "species"]


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_agrees_with_sql(spark, twin_db, name):
    ours, theirs, _ = check_catalog.compare(spark, twin_db, SF_DIR, name)
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
