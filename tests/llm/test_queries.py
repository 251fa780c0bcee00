"""Registered queries: SQL twins, and names as expected."""

import pytest

from corpusflow.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    ok, message = compare(spark, connect(SF), SF, QUERIES[name], SQL[name])
    assert ok, message


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
