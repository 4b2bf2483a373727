"""Every registered query against its SQL, row for row."""

import importlib.util
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from evalspark.plans.oracle import ORACLE  # noqa: E402
from evalspark.plans.registry import QUERIES  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "labels", "embeddings", "events")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


def test_entry_without_training_data(monkeypatch):
    """Whatever lies beside it, the entry gives the other queries where the subpackage is gone."""
    found = importlib.util.find_spec
    for gone in ("evalspark.llm", "corpus_pipeline"):
        monkeypatch.setattr(importlib.util, "find_spec", lambda name, gone=gone: None if name.startswith(gone) else found(name))
        assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
        assert "pipeline" not in entry.queries() and (gone == "corpus_pipeline" or set(entry.queries()) == set(QUERIES))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    ours = [tuple(row[c] for c in columns) for row in frame.collect()]
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = [tuple(row[i] for i in at) for row in cursor.fetchall()]
    assert ordered(ours) == ordered(theirs)
    assert ours


def test_entry(spark):
    assert {row["grp"] for row in entry.entry(spark).collect()} == {"agree", "disagree", "all"}
