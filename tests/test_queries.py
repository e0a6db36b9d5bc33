"""Every query of the engine against its SQL; those without SQL must give rows of a stable schema."""

import pytest
from compare import assert_same

from rankloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries without SQL; other tests hold them against brute force over whole tables or against plain solvers.
NO_SQL = {"match_score_fuzzy", "search_tracks", "add_by_text", "remove_by_text", "entity_fuzzy", "slot_match_fuzzy", "encode_queries", "intent_scores"}


def test_inventory():
    assert set(QUERIES) - set(SQL) == NO_SQL
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1
