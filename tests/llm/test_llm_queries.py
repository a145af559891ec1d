import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import oracle  # noqa: E402

from papyrion.llm import queries  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, con, name):
    oracle.same(spark, con, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_gives_rows(spark, con, name):
    assert queries.QUERIES[name](spark, str(oracle.DATA)).limit(1).count() == 1
