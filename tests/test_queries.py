"""Every registered query against its SQL on the smallest tables."""

import pytest
from docstruct.plans.oracles import ORACLES
from docstruct.plans.registry import QUERIES
from check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in ORACLES
    assert compare(spark, con, SF_DIR, name) is None
