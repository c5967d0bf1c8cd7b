"""Every query against its DuckDB twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from neraca.plans import catalog
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
PLANS, TWINS = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, duck, name):
    assert compare(spark, duck, FOLDER, name, PLANS[name], TWINS.get(name)) is None


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
