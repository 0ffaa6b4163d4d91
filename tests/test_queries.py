"""Every registered query against its checking SQL on the smallest data."""

import pytest
from check import compare, connect
from support import SF

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# The optional operators have their tests in a folder of their own.
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.LLM_QUERIES)))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, entry.queries()[name], SQL.get(name), SF)
    assert ok, note


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 7 and df.columns[:2] == ["model", "setting"]


def test_no_cartesian_product(spark):
    from support import plan_of

    for name in ["noise_rows", "prompt_noisy_preds", "pending", "predicate_matches", "scorecard", "route_prompts"]:
        assert "CartesianProduct" not in plan_of(entry.queries()[name](spark, SF)), name
