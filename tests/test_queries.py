import pytest

from loomgrain.plans import catalog
from tests.conftest import DATA
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert_same(catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
