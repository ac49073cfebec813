"""The queries of this package with SQL against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check

from callweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    problem, _ = check.compare(queries.QUERIES[name](spark, SF), check.duck(SF), queries.ORACLES[name])
    assert problem is None, problem


def test_all_operators():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
