"""Corpus queries with SQL twins, on the whole small tables."""

import pytest

from tests.conftest import compare
from tideline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    assert compare(spark, name, "/root/testdata/sf0.001") == []
