"""Queries of the text operators that SQL can state, against it."""

from __future__ import annotations

import pytest
from oracle import connect, same

from chronoframe.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), connect(sf), ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_and_names_its_columns(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
