import pytest

from tests.compare import SMALL, check
from tidewheel.llm import queries

QUERIES = queries.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        check(spark, QUERIES[name], queries.SQL[name])
    else:
        assert QUERIES[name](spark, SMALL).count() > 0


def test_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(queries.SQL) <= set(e.oracle_sql())
