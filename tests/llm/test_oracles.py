"""Every query with an SQL twin against it, and the shape of the rest."""
import pytest

from ballast.llm import queries as llm
from tests.oracle import differences, duck, sf_dir


@pytest.fixture(scope="module")
def con():
    return duck("0.001")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert differences(llm.queries()[name](spark, sf_dir("0.001")), con, llm.oracle_sql()[name]) == []


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    numbers = sorted(int(n[2:].split("_")[0]) for n in llm.queries())
    assert numbers == list(range(1, 14)) and {"pipeline", *llm.queries()} <= set(entry.queries())
