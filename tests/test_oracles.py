"""Every registered query against its SQL twin on the smallest tables."""
import pytest

from ballast.plans import catalog
from tests.oracle import differences, duck, sf_dir

SF = "0.001"
# the sf0.001 vector table is small enough, the other SQL texts hold at any size
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert differences(catalog.queries()[name](spark, sf_dir(SF)), con, catalog.oracle_sql()[name]) == []


def test_registry_is_consistent():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 2 and len({r["after"] for r in rows}) == 1
