"""Every query that has SQL against it, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from moniker.plans.queries import QUERIES
from moniker.plans.sql import SQL

from .harness import DATA, differences


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert differences(spark, QUERIES[name], SQL[name], f"{DATA}/sf0.001") == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").columns


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
