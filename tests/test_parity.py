"""Every registered query against its DuckDB statement, over whole test tables."""

import pytest

from checks.compare import connect, differences
from checks.oracle import statements
from checks.queries import registered

SF_DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
#: Queries that report amounts; half cents occur in the larger tables.
AMOUNTS = ["warehouse_recos", "warehouse_recos_tight", "warehouse_recos_zero_floor", "job_recos", "digest_payload", "top_actions"]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(registered()) == set(statements())


@pytest.mark.parametrize("name", sorted(registered()))
def test_parity(spark, duck, name):
    _, problem = differences(spark, duck, SF_DIR, name)
    assert not problem


@pytest.mark.parametrize("name", AMOUNTS)
def test_amounts_on_larger_tables(spark, name):
    _, problem = differences(spark, connect(LARGER), LARGER, name)
    assert not problem
