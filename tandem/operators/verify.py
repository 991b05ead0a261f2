"""Comparing state between the two copies, and between a whole and a split replay."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.scalars import offset_at, state_hash
from tandem.operators import fold
from tandem.operators.scan import Running, running


def canonical_columns() -> list[Column]:
    """The hashed form of a customer state: fixed order, the amount in cents."""
    return [
        F.col("customer_id").alias("customerId"),
        F.col("order_count").alias("orderCount"),
        fold.amount_to_cents(F.col("total_amount")).alias("totalCents"),
        F.col("last_event_type").alias("lastEventType"),
        F.col("last_updated_ms").alias("lastUpdatedMs"),
        F.col("state_version").alias("stateVersion"),
    ]


def hash_states(states: DataFrame, key: str = "customer_id", columns: Sequence[Column] | None = None) -> DataFrame:
    return states.select(F.col(key).alias("state_key"), state_hash(columns or canonical_columns()).alias("state_hash"))


def digest_bits(hashed: Column) -> Column:
    """The part of a state hash that goes into the digest of a table."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint")


def table_digest(hashes: DataFrame) -> DataFrame:
    """One order-free digest of all state hashes; equal tables have equal digests."""
    return hashes.agg(F.count(F.lit(1)).alias("states"), F.bit_xor(digest_bits(F.col("state_hash"))).alias("digest"))


def digest_steps(changes: DataFrame, order: Sequence[str] = ("offset", "partition"), initial: DataFrame | None = None) -> DataFrame:
    """What each change does to ``table_digest``: the bits of the old state go out, those of the new one come in.

    ``states`` is 1 where a key appears. Restored states give steps without a position. Hot keys are cut like any scan.
    """
    rows = changes if initial is None else changes.unionByName(initial.select(*fold.STATE_COLUMNS), allowMissingColumns=True)
    rows = rows.select("customer_id", *order, digest_bits(state_hash(canonical_columns())).alias("_bits"))
    return step_rows(running(rows, ["customer_id"], order, Running("_was", "lag", F.col("_bits"))))


def step_rows(rows: DataFrame) -> DataFrame:
    """Steps from rows with the bits of a state (``_bits``) and of the one before it (``_was``)."""
    step = F.col("_bits").bitwiseXOR(F.coalesce("_was", F.lit(0).cast("bigint")))
    return rows.select("partition", "offset", F.col("_was").isNull().cast("int").alias("states"), step.alias("step"))


def digests_at(steps: DataFrame, cuts: Mapping[str, Mapping[int, int]]) -> DataFrame:
    """The digest of the state after the records up to each agreed position, both ends included.

    ``cuts`` names a handful of positions, each an offset per partition; of a partition it does not name nothing counts.
    One pass with partial sums, so a comparison costs what the changes cost, not what the state holds.
    """
    def inside(offsets: Mapping[int, int]) -> Column:
        pairs = [F.lit(n) for entry in sorted(offsets.items()) for n in entry]
        agreed = F.create_map(*pairs).cast("map<int,bigint>")
        return F.col("offset").isNull() | (F.col("offset") <= offset_at(agreed, F.col("partition"), -1))

    held = {name: inside(offsets) for name, offsets in cuts.items()}
    totals = steps.agg(*[
        F.struct(
            F.lit(name).alias("cut"), F.coalesce(F.sum(F.when(here, F.col("states"))), F.lit(0)).cast("bigint").alias("states"),
            F.bit_xor(F.when(here, F.col("step"))).alias("digest"),
        ).alias(f"_{n}")
        for n, (name, here) in enumerate(held.items())
    ])
    return totals.select(F.inline(F.array(*totals.columns)))


def digests_agree(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per position whether both copies hold the same state; a position that one side lacks is no match."""
    theirs = actual.select("cut", F.struct("states", "digest").alias("_theirs"))
    both = expected.select("cut", F.struct("states", "digest").alias("_ours")).join(theirs, "cut", "full_outer")
    same = F.col("_ours").isNotNull() & F.col("_theirs").isNotNull() & F.col("_ours").eqNullSafe(F.col("_theirs"))
    return both.select("cut", same.alias("agree"))


def state_hash_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Hashes of the two copies side by side; a missing or NULL hash never matches."""
    joined = expected.select("state_key", F.col("state_hash").alias("expected_hash")).join(
        actual.select("state_key", F.col("state_hash").alias("actual_hash")), "state_key", "full_outer"
    )
    status = (
        F.when(F.col("expected_hash") == F.col("actual_hash"), "MATCH")
        .when(F.col("expected_hash").isNull(), "MISSING_EXPECTED")
        .when(F.col("actual_hash").isNull(), "MISSING_ACTUAL")
        .otherwise("MISMATCH")
    )
    return joined.withColumn("status", status)


def split_replay(events: DataFrame, at: int, order: Sequence[str] = ("seq",)) -> DataFrame:
    """The final state when the events up to ``at`` are folded first and the rest on top of that snapshot."""
    before, after = events.filter(F.col(order[0]) <= at), events.filter(F.col(order[0]) > at)
    snapshot = fold.latest_state(fold.customer_state_changes(before, order), order)
    return fold.latest_state(fold.customer_state_changes(after, order, snapshot), order, snapshot)


def split_invariance(events: DataFrame, at: int, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Per customer, whether the split replay ends in the same state as the whole replay."""
    whole = hash_states(fold.latest_state(fold.customer_state_changes(events, order), order))
    return state_hash_diff(whole, hash_states(split_replay(events, at, order)))
