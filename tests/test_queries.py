"""Every registered query against its check SQL, on the smallest given tables."""

import pytest

from check import compare, connect
from chartloom.catalog import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(load()))
def test_query(spark, con, name):
    message = compare(spark, con, load()[name], SF)
    assert not message or message.startswith("~"), message
