"""Every registered query against its SQL twin; those without one must run and give rows."""

import pytest

from corpuslab import plans
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_twin(spark, data, duck, name):
    assert_same(plans.QUERIES[name](spark, data).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert plans.QUERIES[name](spark, data).limit(5).count() >= 1


def test_entry_module(spark, data):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(plans.QUERIES) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).columns == ["word", "n"]
