"""Every registered query against its oracle SQL."""

import pytest
from oracle_check import compare, connect

from kveil.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], FOLDER) is None
