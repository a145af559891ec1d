import oracle
import pytest

from papyrion.plans import catalogue

@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, con, name):
    oracle.same(spark, con, catalogue.QUERIES[name], catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_gives_rows(spark, con, name):
    assert catalogue.QUERIES[name](spark, str(oracle.DATA)).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
