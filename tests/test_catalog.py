"""Every query of the catalogue against its SQL, over the whole small tables."""

import pytest

from checks.catalog import QUERIES
from checks.compare import check, connect
from checks.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_agrees(spark, con, sf_dir, name):
    result = check(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
    assert result.startswith("ok") and "TYPES" not in result, result


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.queries()) >= set(QUERIES) and set(contract.oracle_sql()) >= set(ORACLES)
