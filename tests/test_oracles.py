import pytest

from rowforge.plans import catalog
from tests.compare import SMALL, connect, same_rows

QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_entry_points_without_the_training_data_queries(monkeypatch):
    import sys

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("rowforge.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # an import of it fails
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)
