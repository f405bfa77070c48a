import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import compare, connect  # noqa: E402

from sparkrules.plans import catalog, catalog_sessions  # noqa: E402, F401

SF = "/root/testdata/sf0.001"
#: no such events in the smallest sample
EMPTY = {"allen_overlaps", "allen_overlappedby"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_matches_sql(spark, con, name):
    got = compare(spark, con, catalog.QUERIES[name], catalog.SQL[name], SF)
    assert got == "" or (got == "no rows" and name in EMPTY)
