"""Every query against its SQL on the small tables."""

import pytest
from check_oracles import compare, open_oracle

import __spark_entry__ as entry
from rostrum.plans.oracles import ORACLES
from rostrum.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, oracle, name):
    ok, rows, _, diff = compare(spark, oracle, name, FOLDER)
    assert ok, diff
    assert rows > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "prompt_turn", "context"]
    assert df.limit(1).count() == 1
