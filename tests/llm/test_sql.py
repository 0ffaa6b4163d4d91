"""Queries with checking SQL, and the registry."""

import pytest
from check import compare, connect

import __spark_entry__ as entry
from formulary.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    ok, note = compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, note


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) < set(entry.queries())
    assert set(SQL) <= set(QUERIES) and all(entry.oracle_sql()[n] == s for n, s in SQL.items())
