"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from lexmesh.plans import catalogue
from parity import compare, oracle_connection

PLANS, ORACLES = catalogue.plans(), catalogue.oracles()

#: SQL cannot say these; each is held against brute force or fixtures in the tests named.
WITHOUT_SQL = {
    "cover_density_topk": "test_ranking", "norm_structure": "test_structure", "sentence_chunks": "test_structure", "routed_questions": "test_sources",
    "inverted_list_topk": "test_ranking",
}


@pytest.fixture(scope="module")
def con(data):
    return oracle_connection(data)


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(WITHOUT_SQL)))
def test_query(name, spark, con, data):
    ok, note, _ = compare(spark, con, data, PLANS[name], ORACLES.get(name))
    assert ok, note


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_has_rows(name, spark, data):
    assert name not in ORACLES and PLANS[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(PLANS) <= set(entry.queries())
