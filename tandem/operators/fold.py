"""Keyed ordered fold of events into state, with floors, as a prefix scan.

An event moves a quantity ``x`` to ``max(floor, x + d)`` when its rule is floored and to ``x + d`` when it
is not. With ``D`` the running sum of ``d`` the value after an event is

    D + greatest(0, running max of -D over the floored events so far)

so the fold needs no row-by-row code. A chunk of events reduces to the pair (sum of d, max of -D over its
floored events), which is what hot keys carry from chunk to chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators import scan

STATE_VERSION = 1

# The event types the fold accepts.
CREATED = "ORDER_CREATED"
UPDATED = "ORDER_UPDATED"
CANCELLED = "ORDER_CANCELLED"
KNOWN_TYPES = (CREATED, UPDATED, CANCELLED)


@dataclass(frozen=True)
class Step:
    """What one event type does to a quantity."""

    delta: Column
    floored: bool = False


@dataclass(frozen=True)
class Quantity:
    """A folded BIGINT column; event types without a step leave it alone."""

    name: str
    steps: Mapping[str, Step]

    def delta(self, event_type: Column) -> Column:
        out = F.lit(0)
        for name, step in self.steps.items():
            out = F.when(event_type == name, step.delta).otherwise(out)
        return out.cast("bigint")

    def floored(self, event_type: Column) -> Column:
        names = [name for name, step in self.steps.items() if step.floored]
        return event_type.isin(*names) if names else F.lit(False)


def order_quantities() -> list[Quantity]:
    cents = F.col("amount_cents")
    return [
        Quantity("order_count", {CREATED: Step(F.lit(1)), CANCELLED: Step(F.lit(-1), floored=True)}),
        Quantity("total_cents", {CREATED: Step(cents), UPDATED: Step(cents, floored=True), CANCELLED: Step(-cents, floored=True)}),
    ]


def fold(events: DataFrame, keys: Sequence[str], order: Sequence[str], event_type: str, quantities: Sequence[Quantity], initial: DataFrame | None = None) -> DataFrame:
    """One output row per event with every quantity after it.

    ``initial`` (keys and quantities) restores earlier state. It enters as one more event at the front of
    its key, so restoring costs no join.
    """
    kind = F.col(event_type)
    rows = events.withColumns({f"_delta_{q.name}": q.delta(kind) for q in quantities})
    rows = rows.withColumns({f"_floored_{q.name}": q.floored(kind) for q in quantities})
    hot = scan.find_hot_keys(rows, keys, order[0])
    if initial is not None:
        rows = rows.withColumn("_first", F.lit(1)).unionByName(
            initial.select(
                *keys,
                *[F.col(q.name).cast("bigint").alias(f"_delta_{q.name}") for q in quantities],
                *[F.lit(False).alias(f"_floored_{q.name}") for q in quantities],
                F.lit(0).alias("_first"),
            ),
            allowMissingColumns=True,
        )
        order = ["_first", *order]

    window = scan.chunk_window(hot, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunked = scan.with_chunk(rows, hot)
    sums = chunked.withColumns({f"_sum_{q.name}": F.sum(f"_delta_{q.name}").over(window) for q in quantities})
    local = sums.withColumns(
        {f"_floor_{q.name}": F.max(F.when(F.col(f"_floored_{q.name}"), -F.col(f"_sum_{q.name}"))).over(window) for q in quantities}
    )
    if hot.found:
        local = _complete(sums, local, hot, quantities)
    out = local.withColumns(
        {q.name: F.col(f"_sum_{q.name}") + F.greatest(F.lit(0).cast("bigint"), F.col(f"_floor_{q.name}")) for q in quantities}
    )
    if initial is not None:
        out = out.filter(F.col("_first") == 1)
    return out.drop("_first", scan.CHUNK, *[f"_{p}_{q.name}" for q in quantities for p in ("delta", "floored", "sum", "floor")])


def _complete(sums: DataFrame, local: DataFrame, hot: scan.HotKeys, quantities: Sequence[Quantity]) -> DataFrame:
    """Add what earlier chunks of a hot key contribute to the running sum and the running max."""
    summary = [F.sum(f"_delta_{q.name}").alias(f"_chunk_sum_{q.name}") for q in quantities]
    summary += [F.max(F.when(F.col(f"_floored_{q.name}"), -F.col(f"_sum_{q.name}"))).alias(f"_chunk_floor_{q.name}") for q in quantities]
    zero = F.lit(0).cast("bigint")
    chunks = scan.carry(sums, hot, summary, lambda over: [
        *[F.coalesce(F.sum(f"_chunk_sum_{q.name}").over(over.rowsBetween(Window.unboundedPreceding, -1)), zero).alias(f"_sum_before_{q.name}") for q in quantities],
        *[F.col(f"_chunk_floor_{q.name}") for q in quantities],
    ])
    earlier = Window.partitionBy(*hot.keys).orderBy(scan.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(
        *hot.partition,
        *[F.col(f"_sum_before_{q.name}") for q in quantities],
        *[F.max(F.col(f"_chunk_floor_{q.name}") - F.col(f"_sum_before_{q.name}")).over(earlier).alias(f"_floor_before_{q.name}") for q in quantities],
    )
    joined = scan.attach(local, before, hot)
    for q in quantities:
        base = F.coalesce(F.col(f"_sum_before_{q.name}"), zero)
        joined = joined.withColumns({
            f"_floor_{q.name}": F.greatest(F.col(f"_floor_before_{q.name}"), F.col(f"_floor_{q.name}") - base),
            f"_sum_{q.name}": F.col(f"_sum_{q.name}") + base,
        })
    return joined.drop(*[f"_{p}_{q.name}" for q in quantities for p in ("sum_before", "floor_before")])


def cents_to_amount(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def amount_to_cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def known_events(events: DataFrame) -> DataFrame:
    """Events of unknown type change no state and give no row."""
    return events.filter(F.col("event_type").isin(*KNOWN_TYPES))


def unknown_event_types(events: DataFrame) -> DataFrame:
    """What ``known_events`` leaves out, counted; a missing type counts as unknown."""
    unknown = F.col("event_type").isNull() | ~F.col("event_type").isin(*KNOWN_TYPES)
    return events.filter(unknown).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def key_partitions(events: DataFrame) -> DataFrame:
    """The partitions each customer's events lie in.

    Arrival order is the producer's order only for a customer in one partition; with several, (partition,
    offset) is merely a fixed order.
    """
    return events.groupBy("customer_id").agg(
        F.min("partition").alias("first_partition"), F.max("partition").alias("last_partition"), F.count(F.lit(1)).alias("events")
    )


def customer_state_changes(events: DataFrame, order: Sequence[str] = ("seq",), initial: DataFrame | None = None) -> DataFrame:
    """The state of the event's customer after each accepted event, in arrival order."""
    if initial is not None:
        initial = initial.select("customer_id", "order_count", amount_to_cents(F.col("total_amount")).alias("total_cents"))
    rows = known_events(events).select(
        *dict.fromkeys([*order, "event_id", "customer_id", "event_type", "event_ts_ms"]),
        amount_to_cents(F.col("amount")).alias("amount_cents"),
    )
    folded = fold(rows, ["customer_id"], list(order), "event_type", order_quantities(), initial)
    return folded.select(
        *order,
        "event_id",
        "customer_id",
        F.col("order_count").cast("int").alias("order_count"),
        cents_to_amount(F.col("total_cents")).alias("total_amount"),
        F.col("event_type").alias("last_event_type"),
        F.col("event_ts_ms").alias("last_updated_ms"),
        F.lit(STATE_VERSION).alias("state_version"),
    )


STATE_COLUMNS = ("customer_id", "order_count", "total_amount", "last_event_type", "last_updated_ms", "state_version")


def latest_state(changes: DataFrame, order: Sequence[str] = ("seq",), initial: DataFrame | None = None) -> DataFrame:
    """The last state per customer by arrival; customers without new events keep the restored one."""
    value = [c for c in STATE_COLUMNS if c != "customer_id"]
    rows = changes.select(*order, *STATE_COLUMNS)
    if initial is not None:
        rows = rows.unionByName(initial.select(*STATE_COLUMNS), allowMissingColumns=True)
    # a restored row has no position, and NULL sorts before every position
    last = rows.groupBy("customer_id").agg(F.max(F.struct(*order, *value)).alias("s"))
    return last.select("customer_id", *[F.col(f"s.{c}").alias(c) for c in value])
