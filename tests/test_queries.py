import os

import pytest

from oracle_check import compare, duck

from verdara.plans.oracle import all_sql
from verdara.plans.queries import all_queries

SF_DIR = os.environ.get("VERDARA_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF_DIR)
    if name in all_sql():
        assert compare(df, con, all_sql()[name]) == ""
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
