"""Every query against its SQL twin, and the stability of its schema."""

import pytest

import __spark_entry__ as entry
from tests.conftest import compare
from tideline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, name):
    assert compare(spark, name, SF) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    frame = entry.queries()[name](spark, SF)
    assert len(frame.columns) == len(set(frame.columns))
    frame.collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
