import pytest

import __spark_entry__ as entry
from tests.oracle import duck, same
from tremolo.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in ORACLES:
        same(got, db.execute(ORACLES[name]).df())
    else:
        assert len(got)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
