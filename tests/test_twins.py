"""Every query of the library against its DuckDB twin, on the smallest tables."""

import pytest

from tests.compare import difference, duck
from tilewright import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, con, name):
    assert difference(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_twin(spark, name):
    """Their results are held against plain Python in test_unproved, test_grids and test_runs."""
    assert registry.queries()[name](spark, SF).count() > 0
