import pytest

from tests.compare import SMALL, check
from tidewheel import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_deterministic_samples(spark):
    for name in ("hash_sample_limit", "weighted_mix", "fake_source"):
        a, b = (sorted(map(str, QUERIES[name](spark, SMALL).collect())) for _ in range(2))
        assert a == b
