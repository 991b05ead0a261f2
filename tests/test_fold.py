"""The fold, the conditional write and the verifier against step-by-step forms."""

import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandem.operators import fold, upsert, verify

from tests.conftest import rows

KINDS = ["ORDER_CREATED", "ORDER_UPDATED", "ORDER_CANCELLED"]
SCHEMA = "seq bigint, event_id string, customer_id string, event_type string, amount decimal(18,2), event_ts_ms bigint"


def step(state, kind, amount):
    count, total = state
    if kind == "ORDER_CREATED":
        return count + 1, total + amount
    if kind == "ORDER_UPDATED":
        return count, max(Decimal(0), total + amount)
    return max(0, count - 1), max(Decimal(0), total - amount)


def events(seed, size=400):
    rng = random.Random(seed)
    return [
        (n, f"e{n}", rng.choice(["hot", "hot", "hot", "a", "b", "c"]), rng.choice(KINDS),
         Decimal(rng.randrange(-5000, 5001)) / 100, rng.randrange(1000))
        for n in range(size)
    ]


def folded(data, states=None):
    states = dict(states or {})
    out = []
    for seq, event_id, customer, kind, amount, ts in data:
        states[customer] = step(states.get(customer, (0, Decimal(0))), kind, amount)
        out.append((seq, customer, *states[customer], kind, ts))
    return out


def changes_of(df):
    return sorted((r.seq, r.customer_id, r.order_count, r.total_amount, r.last_event_type, r.last_updated_ms) for r in df.collect())


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_steps(spark, request, seed, split):
    if split:
        request.getfixturevalue("small_chunks")
    data = events(seed)
    assert changes_of(fold.customer_state_changes(spark.createDataFrame(data, SCHEMA))) == folded(data)


@pytest.mark.parametrize("split", [False, True])
def test_fold_on_restored_state(spark, request, split):
    if split:
        request.getfixturevalue("small_chunks")
    data = events(4)
    # a negative total can be restored, since creations do not floor
    start = {"hot": (3, Decimal("12.50")), "b": (1, Decimal("-4.00")), "unseen": (9, Decimal("1.00"))}
    snapshot = spark.createDataFrame(
        [(c, n, total, "ORDER_CREATED", 5, 1) for c, (n, total) in start.items()],
        "customer_id string, order_count int, total_amount decimal(18,2), last_event_type string, last_updated_ms bigint, state_version int",
    )
    df = spark.createDataFrame(data, SCHEMA)
    changes = fold.customer_state_changes(df, initial=snapshot)
    assert changes_of(changes) == folded(data, start)
    latest = {r.customer_id: (r.order_count, r.total_amount) for r in fold.latest_state(changes, initial=snapshot).collect()}
    assert latest["unseen"] == start["unseen"]
    assert latest["hot"] == [r for r in folded(data, start) if r[1] == "hot"][-1][2:4]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(KINDS), st.integers(-50, 50)), max_size=30), st.integers(0, 20))
def test_prefix_form_equals_steps(steps, x0):
    """The algebra behind the scan, without Spark."""
    total, running, floor = x0, 0, None
    for kind, amount in steps:
        delta = -amount if kind == "ORDER_CANCELLED" else amount
        running += delta
        if kind == "ORDER_CREATED":
            total += delta
        else:
            total = max(0, total + delta)
            floor = -running if floor is None else max(floor, -running)
        assert total == running + max(x0, x0 if floor is None else floor)


def test_unknown_types_change_nothing(spark):
    data = [(0, "e0", "a", "ORDER_CREATED", Decimal(5), 1), (1, "e1", "a", "ORDER_VIEWED", Decimal(7), 2), (2, "e2", "a", None, Decimal(7), 3)]
    df = spark.createDataFrame(data, SCHEMA)
    assert [r.event_id for r in fold.customer_state_changes(df).collect()] == ["e0"]
    assert rows(fold.unknown_event_types(df)) == rows(spark.createDataFrame([("ORDER_VIEWED", 1), (None, 1)], "event_type string, events bigint"))


def one_by_one(writes, stored):
    stored = dict(stored)
    accepted = []
    for key, version, seq, value in writes:
        ok = key not in stored or stored[key][0] < version
        if ok:
            stored[key] = (version, value)
        accepted.append(ok)
    return stored, accepted


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_upsert_equals_single_writes(spark, small_chunks, seed):
    rng = random.Random(seed)
    writes = [(rng.choice("hhhab"), rng.randrange(12), n, f"v{n}") for n in range(200)]
    current = {"h": (5, "old"), "z": (1, "kept")}
    df = spark.createDataFrame(writes, "k string, version int, seq bigint, value string")
    table = spark.createDataFrame([(k, v, value) for k, (v, value) in current.items()], "k string, version int, value string")
    stored, _ = one_by_one(writes, current)
    got = {r.k: (r.version, r.value) for r in upsert.conditional_upsert(df, "k", "version", ["seq"], table).collect()}
    assert got == stored
    _, accepted = one_by_one(writes, {})
    audit = {r.seq: r.accepted for r in upsert.conditional_write_audit(df, "k", "version", ["seq"]).collect()}
    assert [audit[n] for n in range(200)] == accepted


def test_hash_compare(spark):
    states = "customer_id string, order_count int, total_amount decimal(18,2), last_event_type string, last_updated_ms bigint, state_version int"
    one = spark.createDataFrame([("a", 1, Decimal("2.00"), "ORDER_CREATED", 5, 1), ("b", 1, Decimal("2.00"), None, 5, 1), ("c", 1, Decimal(1), None, 5, 1)], states)
    two = one.filter("customer_id <> 'c'").withColumn("total_amount", F.when(F.col("customer_id") == "b", Decimal("2.01")).otherwise(F.col("total_amount")).cast("decimal(18,2)"))
    diff = {r.state_key: r.status for r in verify.state_hash_diff(verify.hash_states(one), verify.hash_states(two)).collect()}
    assert diff == {"a": "MATCH", "b": "MISMATCH", "c": "MISSING_ACTUAL"}
    none = spark.createDataFrame([("a", None)], "state_key string, state_hash string")
    assert verify.state_hash_diff(none, none).first().status != "MATCH"
    assert verify.table_digest(verify.hash_states(one)).first() == verify.table_digest(verify.hash_states(one.orderBy(F.desc("customer_id")))).first()


def test_split_anywhere_gives_the_same_state(spark):
    df = spark.createDataFrame(events(9, 120), SCHEMA)
    for at in (0, 17, 60, 118):
        assert {r.status for r in verify.split_invariance(df, at).collect()} == {"MATCH"}


def test_items_for_a_key_value_store(spark):
    row = spark.createDataFrame([("a", 2, Decimal("1.50"), None)], "customer_id string, order_count int, total_amount decimal(18,2), last_event_type string")
    assert upsert.key_value_items(row).first().item == {"customer_id": "a", "order_count": "2", "total_amount": "1.50"}
