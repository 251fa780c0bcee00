"""Every registered query with a SQL twin equals it on the smallest tables."""

import os

import pytest

from corpusflow.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables missing")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, con, name):
    ok, message = compare(spark, con, SF, registry.QUERIES[name], registry.SQL[name])
    assert ok, message


def test_twins_are_registered():
    assert set(registry.SQL) <= set(registry.QUERIES)
