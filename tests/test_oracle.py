"""Every registered query against its SQL twin on the smallest scale."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
# the training-data queries (op..., pipeline) have tests of their own, against brute force
NAMES = sorted(n for n in E.queries() if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, SF, name, E.queries()[name], E.oracle_sql().get(name))
    assert r["status"] == "match", r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "chunk_no", "score", "content"]
    assert df.count() > 0
