"""The registered queries against their SQL twins, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tidegraph.plans.oracle import oracle_queries
from tidegraph.plans.queries import registered_queries

SF = "/root/testdata/sf0.001"

# One or two per area; check_oracle.py runs them all.
SAMPLE = [
    "relationship_extraction",
    "reverse_closure_dangling",
    "max_relevant_seqs",
    "hydrate_cycle",
    "apply_writes_stored",
    "compact_history",
    "feed_next_cursor",
    "ack_progress",
    "heartbeat",
    "validate_writes",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_every_query_has_a_twin_with_the_same_columns(db):
    assert set(registered_queries()) == set(oracle_queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    for sql in contract.oracle_sql().values():
        db.execute(f"EXPLAIN {sql}")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin(spark, db, name):
    ours = contract.queries()[name](spark, SF)
    columns = sorted(ours.columns)
    cursor = db.execute(contract.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    want = sorted(repr(tuple(row[theirs.index(c)] for c in columns)) for row in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in ours.collect()) == want


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
