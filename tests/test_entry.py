"""Every registered query of the library against its SQL, at the smallest scale."""

import compare
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from oracles import ORACLES

# At this scale a report on a threshold that fits few rows, or a page beyond the last pair, may be empty.
MAY_BE_EMPTY = {"pair_page", "invalid_labels"}


@pytest.fixture(scope="module")
def database():
    return compare.connect(SMALL)


def test_every_query_has_sql():
    assert {f.__name__ for f in entry.QUERIES} == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(f.__name__ for f in entry.QUERIES))
def test_query_matches_sql(spark, database, name):
    df = entry.queries()[name](spark, SMALL)
    got = compare.spark_result(df)
    assert got[1] or name in MAY_BE_EMPTY, "an empty result proves nothing"
    assert compare.difference(got, compare.sql_result(database, ORACLES[name])) is None
    assert compare.type_difference(df, database, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["cluster_id", "part", "size", "members"]
