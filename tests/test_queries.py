import pytest

from lodestone.plans.oracles import ORACLE_SQL
from lodestone.plans.queries import QUERIES

from .oracle import compare, database

#: At this scale every activity is matched and no supplier has a name that is searched for.
EMPTY = {"unmatched_activities", "workspace_search"}


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, con, name):
    rows = compare(QUERIES[name](spark, sf), con, ORACLE_SQL[name])
    assert rows > 0 or name in EMPTY


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
