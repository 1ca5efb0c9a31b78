"""Every query with SQL agrees with DuckDB at the smallest size; the others run."""

import pytest

from barlake import plans
from tests.compare import connect, differ

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_agrees(spark, con, name):
    assert differ(spark, con, name, plans.queries()[name], plans.oracles()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracles())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
