"""Every registered query runs, and equals its SQL where it has one."""

import pytest
from oracle_check import check, connect

from loomgraph.plans import PLANS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(PLANS))
def test_query_matches_sql(spark, duck, name):
    ok, info = check(spark, duck, FOLDER, name)
    assert ok, info
