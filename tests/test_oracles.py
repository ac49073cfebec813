"""Every query with SQL against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    problem, _ = check.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", ["g4_business_features", "g2_conversation_sentiment", "j1_align_transcript", "a4_speech_regions"])
def test_result_does_not_depend_on_partitions(spark, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        problem, _ = check.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
