"""Every registered query against its SQL text."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from clickloom import oracles, registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracles.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    names, expected = compare.sql_rows(con, entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(names)
    assert compare.spark_rows(df) == expected
