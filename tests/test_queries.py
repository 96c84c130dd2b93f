"""Every record query against the SQL that says the same."""

import pytest

from rollbook import queries as records

#: Jobs that go through their rows in an order, which SQL doesn't express: see test_consolidation.
ORDERED = {"automatic_merges", "tenures_folded"}


@pytest.mark.parametrize("name", sorted(set(records.queries()) - ORDERED))
def test_same_as_sql(name, same):
    same(records.queries()[name], records.oracle_sql()[name])


def test_all_others_have_sql():
    assert set(records.queries()) - set(records.oracle_sql()) == ORDERED
