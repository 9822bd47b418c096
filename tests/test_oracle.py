"""Every query of the catalogue equals its DuckDB SQL on the smallest tables."""

import os

import pytest

from lorespark import catalog
from tests.oracle import compare, connect

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
#: Empty on tables this small, compared all the same.
MAY_BE_EMPTY = {"gaps", "cooccurrence", "pattern_entities", "reformulated_search", "inverse_relationships", "null_policy_conflicts"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    why = compare(spark, con, SF_DIR, catalog.queries()[name], catalog.oracle_sql().get(name))
    assert not why or (why == "no rows" and name in MAY_BE_EMPTY), why


def test_every_query_has_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"chunking"}
