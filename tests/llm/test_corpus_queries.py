import os

import pytest

from verdara.llm.queries import QUERIES, SQL

SF = os.environ.get("VERDARA_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_per_input_row(spark, name):
    table = "pages" if name.startswith("op3") else "documents"
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = QUERIES[name](spark, SF)
    n = got.select("doc_id").distinct().count() if name.startswith("op2") else got.count()
    assert n == rows


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, name):
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__))))
    from oracle_check import compare, duck

    assert compare(QUERIES[name](spark, SF), duck(SF), SQL[name]) == ""
