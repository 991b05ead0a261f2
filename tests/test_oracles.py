"""Every query with an oracle gives the same rows as DuckDB over the whole sf0.01 tables."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tandem.plans.oracles import ORACLES
from tandem.plans.queries import QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, dict):
        return sorted((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, float):
        return round(value, 9)
    return value


def connect(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture(scope="module")
def duck_small():
    return connect(SMALL)


def compare(duck, spark, name, sf=SF):
    ours = entry.queries()[name](spark, sf)
    columns = sorted(ours.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert columns == sorted(theirs)
    pick = [theirs.index(c) for c in columns]
    expected = sorted(([plain(r[i]) for i in pick] for r in cursor.fetchall()), key=repr)
    got = sorted(([plain(r[c]) for c in columns] for r in ours.collect()), key=repr)
    assert len(got) == len(expected)
    assert got == expected
    return len(got)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(duck, spark, name):
    assert compare(duck, spark, name) > 0


# one query per operator whose plan changes when keys are hot
SCANS = [
    "app2_ready_times",
    "conditional_upsert",
    "conditional_write_audit_ties",
    "customer_state_changes_ooo",
    "handoff_coverage",
    "handoff_outcomes",
    "heartbeat_gaps",
    "leader_transfers",
    "lease_intervals",
    "mode_timeline",
    "signals_for_trace",
    "split_brain_intervals",
    "split_invariance",
    "state_digest_at_offsets",
    "sustained_alerts",
    "write_mode_asof",
]


@pytest.mark.parametrize("name", SCANS)
def test_same_rows_when_every_key_is_split(duck_small, spark, small_chunks, name):
    assert compare(duck_small, spark, name, SMALL) > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
