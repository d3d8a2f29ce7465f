"""The entry point's contract."""

import __spark_entry__ as entry_point
from foliometry import queries as sections


def test_entry_runs(spark):
    got = entry_point.entry(spark)
    assert got.columns == ["section_id", "cb", "grey", "granular", "molecular"] and got.count() > 0


def test_queries_and_oracles_are_registered():
    names, oracles = set(entry_point.queries()), set(entry_point.oracle_sql())
    assert oracles <= names and set(sections.QUERIES) <= names and set(sections.ORACLES) <= set(sections.QUERIES)
