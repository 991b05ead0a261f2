"""The keyed fold as a stream: with Spark's state store, or batch by batch with the chunked scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tandem.functions.scalars import state_hash
from tandem.operators import fold, verify
from tandem.schemas import CUSTOMER_STATE
from tandem.streaming.packed import pack, unpack
from tandem.streaming.runtime import not_written_yet, use_state_store, writer_run

STATE_NAME = "customer-state"
# Customers share this many keys of the state processor, as a call of it costs far more than a customer. Fixed: checkpoints are keyed by it.
BUCKETS = 512
STATE_SCHEMA = "order_count INT, total_cents BIGINT, last_event_type STRING, last_updated_ms BIGINT, state_version INT"
CHANGE_SCHEMA = f"partition INT, offset BIGINT, event_id STRING, customer_id STRING, {STATE_SCHEMA}"
STATE_FIELDS = [field.split()[0] for field in STATE_SCHEMA.split(", ")]
# the state before a change; a key without one is marked, as its fields then mean nothing
BEFORE_SCHEMA = ", ".join(["is_new BOOLEAN", *[f"was_{field}" for field in STATE_SCHEMA.split(", ")]])


@dataclass(frozen=True)
class Added:
    """A state field that versions from ``since`` on have, for a stream whose checkpoint may hold older states.

    ``start`` gives the value for a state of an earlier version, as a dict of its fields, or for a new key (None).
    ``follow`` gives the values after each event, from the one before them and the event and state columns as arrays.
    Values are fixed-width and never null.
    """

    name: str
    sql_type: str
    since: int
    start: Callable[[dict | None], object]
    follow: Callable[[object, dict[str, np.ndarray]], np.ndarray]


#: Version 2 keeps the highest total since a customer's first event, or since the upgrade.
PEAK = Added(
    "peak_cents", "BIGINT", 2, lambda held: held["total_cents"] if held else 0,
    lambda value, rows: np.maximum.accumulate(np.maximum(rows["total_cents"], value)),
)


def floored_sums(start: int, steps: np.ndarray, floored: np.ndarray) -> np.ndarray:
    """The values of a running sum from ``start`` that is raised to 0 after each ``floored`` step.

    Such steps compose, so the value is the plain sum plus the highest that the start or a floor has lifted it so far.
    """
    sums = np.cumsum(steps)
    return sums + np.maximum.accumulate(np.where(floored, np.maximum(start, -sums), start))


class CustomerStateProcessor(StatefulProcessor):
    """Folds the events of a bucket of customers, as arrays. Rows of a batch come unsorted, so they are put in arrival order first.

    What is sorted is a bucket's share of one micro-batch, which the source's limit per trigger bounds. States are a map
    by customer: only those of a batch's customers are read and written.

    With ``added`` the state is wider. A checkpoint that narrower processors wrote goes on: its states are read as they
    are, and one is brought to the newest version when its customer's next event comes.
    """

    def __init__(self, with_before: bool = False, added: Sequence[Added] = ()) -> None:
        self._with_before, self._added = with_before, tuple(added)
        self._version = max([fold.STATE_VERSION, *(a.since for a in self._added)])

    @property
    def added_names(self) -> list[str]:
        return [a.name for a in self._added]

    @property
    def _more(self) -> str:
        return "".join(f", {a.name} {a.sql_type}" for a in self._added)

    @property
    def schema(self) -> str:
        """The columns of the rows that come out."""
        return f"{CHANGE_SCHEMA}{self._more}" + (f", {BEFORE_SCHEMA}" if self._with_before else "")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getMapState(STATE_NAME, "customer_id STRING", STATE_SCHEMA + self._more)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in initialState.to_dict("records"):
            held = tuple(row[c] for c in STATE_FIELDS)
            self._state.updateValue((row["customer_id"],), self._upgraded(held, [row.get(c) for c in self.added_names]))

    def _upgraded(self, held: tuple, had: Sequence) -> tuple:
        """A state with every field of this processor's version; ``had`` are added fields, which stay if its version has them."""
        if not self._added:
            return held
        fields = dict(zip(STATE_FIELDS, held, strict=True))
        more = [a.start(fields) if fields["state_version"] < a.since else value for a, value in zip(self._added, had, strict=True)]
        return (*held[:-1], max(held[-1], self._version), *more)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = unpack(rows)
        customers = table["customer_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = customers.indices.to_numpy()
        order = np.lexsort((table["offset"].to_numpy(), table["partition"].to_numpy(), codes))
        columns = {c: table[c].to_numpy()[order] for c in ("partition", "offset", "event_id", "event_type", "amount_cents", "event_ts_ms")}
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1)).tolist()
        parts = [
            self._followed(customer, {c: values[a:b] for c, values in columns.items()})
            for customer, a, b in zip(customers.dictionary.take(pa.array(codes[order][starts])).to_pylist(), starts, [*starts[1:], len(order)], strict=True)
        ]
        yield pd.DataFrame({c: np.concatenate([part[c] for part in parts]) for c in parts[0]})

    def _followed(self, customer: str | None, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The rows that come out for one customer's events, which are in order; the last one is the state that is kept."""
        held = self._state.getValue((customer,))
        if held is None:
            state = (0, 0, None, None, self._version, *(a.start(None) for a in self._added))
        else:
            state = self._upgraded(held[: len(STATE_FIELDS)], held[len(STATE_FIELDS) :])
        count, cents, _, _, version, *more = state
        kind, amount, at = rows["event_type"], rows["amount_cents"], rows["event_ts_ms"]
        created, cancelled = kind == fold.CREATED, kind == fold.CANCELLED
        counts = floored_sums(count, created.astype(np.int64) - cancelled, cancelled)
        totals = floored_sums(cents, np.where(cancelled, -amount, amount), ~created)
        columns = {"event_type": kind, "amount_cents": amount, "event_ts_ms": at, "order_count": counts, "total_cents": totals}
        followed = {a.name: a.follow(value, columns) for a, value in zip(self._added, more, strict=True)}
        last = (values[-1].item() for values in followed.values())
        self._state.updateValue((customer,), (int(counts[-1]), int(totals[-1]), kind[-1], int(at[-1]), version, *last))
        out = {
            "partition": rows["partition"], "offset": rows["offset"], "event_id": rows["event_id"], "customer_id": np.full(len(kind), customer, object),
            "order_count": counts.astype(np.int32), "total_cents": totals, "last_event_type": kind, "last_updated_ms": at,
            "state_version": np.full(len(kind), version, np.int32), **followed,
        }
        if self._with_before:
            before = {"is_new": (np.arange(len(kind)) == 0) & (held is None)}
            for name, first in zip(STATE_FIELDS, held or (0, 0, "", 0, 0)):
                before[f"was_{name}"] = np.concatenate([np.array([first], out[name].dtype), out[name][:-1]])
            out |= before
        return out

    def close(self) -> None:
        pass


def stream_customer_state(events: DataFrame, snapshot: DataFrame | None = None, added: Sequence[Added] = ()) -> DataFrame:
    """State changes of a stream of events, optionally on top of a snapshot.

    No time mode is set: every record folds, however late, as a watermark with a time mode would drop some.
    ``added`` widens the state by columns; the stream may be started so on a checkpoint written without them, if that was
    begun under ``runtime.evolving_states``.
    """
    return with_amount(_processed(events, snapshot, CustomerStateProcessor(added=added)))


def stream_digest_steps(events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """``verify.digest_steps`` of a stream: what each change puts into and takes out of the digest of the state.

    The processor gives the state before a change beside the one after it, and both are hashed by column functions.
    Steps of the snapshot itself are ``verify.digest_steps`` of no changes on top of it.
    """
    rows = _processed(events, snapshot, CustomerStateProcessor(with_before=True))
    after = with_amount(rows.select("customer_id", *STATE_FIELDS, *[c for c in rows.columns if c not in ("customer_id", *STATE_FIELDS)]))
    bits = verify.digest_bits(state_hash(verify.canonical_columns()))
    hashed = after.withColumn("_bits", bits).select(
        "partition", "offset", "customer_id", "is_new", "_bits", *[F.col(f"was_{c}").alias(c) for c in STATE_FIELDS]
    )
    before = F.when(~F.col("is_new"), bits)
    return verify.step_rows(with_amount(hashed).withColumn("_was", before))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("customer_id"), F.lit(BUCKETS)).cast("int")


def _processed(events: DataFrame, snapshot: DataFrame | None, processor: CustomerStateProcessor) -> DataFrame:
    spark = events.sparkSession
    use_state_store(spark)
    rows = fold.known_events(events).select(
        "partition", "offset", "event_id", "customer_id", "event_type",
        fold.amount_to_cents(F.col("amount")).alias("amount_cents"), "event_ts_ms",
    )
    initial = None
    if snapshot is not None:
        initial = snapshot.select(
            "customer_id", "order_count", fold.amount_to_cents(F.col("total_amount")).alias("total_cents"),
            "last_event_type", "last_updated_ms", "state_version", *(c for c in processor.added_names if c in snapshot.columns),
        ).withColumn("bucket", _bucket()).groupBy("bucket")
    packed = pack(rows.withColumn("bucket", _bucket()), ["bucket"])
    return packed.groupBy("bucket").transformWithStateInPandas(processor, processor.schema, "Append", "None", initial)


def with_amount(states: DataFrame) -> DataFrame:
    """Cents as the decimal amount of the public schema."""
    columns = [fold.cents_to_amount(F.col(c)).alias("total_amount") if c == "total_cents" else F.col(c) for c in states.columns]
    return states.select(*columns)


def read_snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The customer states held by a stream's checkpoint, also of one that was keyed by customer and cannot go on: it can start a stream."""
    use_state_store(spark)
    spark.streams  # noqa: B018  the state reader needs the streaming manager to exist
    stored = spark.read.format("statestore").option("stateVarName", STATE_NAME).load(checkpoint)
    if "user_map_key" not in stored.columns:  # a checkpoint from before customers shared keys
        return with_amount(stored.select(F.col("key.customer_id").alias("customer_id"), "value.*"))
    return with_amount(stored.select(F.col("user_map_key.customer_id").alias("customer_id"), "user_map_value.*"))


class BatchFold:
    """The fold for ``foreachBatch``: hot customers are cut into chunks, and no Python touches a row.

    Each batch folds on top of the states written by earlier batches and appends its changes and the states
    of the customers it touched under its own number, so a replayed batch rewrites the same files. Every
    ``full_every`` batches all states are written, and readers start from there. A folder belongs to one checkpoint:
    a stream with another one, whose batch numbers begin again, is refused before it writes anything.
    """

    def __init__(self, spark: SparkSession, folder: str, full_every: int = 20) -> None:
        self._spark, self._full_every = spark, full_every
        self.changes_path, self.states_path, self._runs_path = f"{folder}/changes", f"{folder}/states", f"{folder}/runs"
        self._run = None

    def _claim(self, run: str) -> None:
        """Note the stream that the folder belongs to, or fail if it is another one."""
        if run == self._run:
            return
        try:
            owner = self._spark.read.schema("run STRING").parquet(self._runs_path).first()
        except AnalysisException as error:
            if not not_written_yet(error):
                raise
            owner = None
        if owner is None:
            self._spark.range(1).select(F.lit(run).alias("run")).write.mode("overwrite").parquet(self._runs_path)
        elif owner["run"] != run:
            raise ValueError(f"{self.changes_path} belongs to the stream {owner['run']}; a stream with a new checkpoint needs a new folder")
        self._run = run

    def states(self, before: int | None = None) -> DataFrame | None:
        """The newest state per customer, optionally as of the start of a batch."""
        try:
            rows = self._spark.read.schema(f"{CUSTOMER_STATE}, full INT, batch BIGINT").parquet(self.states_path)
        except AnalysisException as error:
            if not not_written_yet(error):
                raise
            return None
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        # only the folder names are needed to find the last full set
        start = rows.filter("full = 1").agg(F.max("batch").alias("batch")).first()["batch"]
        if start is not None:
            rows = rows.filter(F.col("batch") >= start)
        value = [c for c in fold.STATE_COLUMNS if c != "customer_id"]
        last = rows.groupBy("customer_id").agg(F.max(F.struct("batch", *value)).alias("s"))
        return last.select("customer_id", *[F.col(f"s.{c}").alias(c) for c in value])

    def changes(self) -> DataFrame:
        return self._spark.read.schema(f"seq BIGINT, event_id STRING, {CUSTOMER_STATE}, batch BIGINT").parquet(self.changes_path).drop("batch")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._claim(writer_run(batch.sparkSession))
        batch.persist()
        try:
            self._fold(batch, batch_id)
        finally:
            batch.unpersist()

    def _fold(self, batch: DataFrame, batch_id: int) -> None:
        known = self.states(before=batch_id)
        touched = fold.known_events(batch).select("customer_id").distinct()
        initial = known.join(touched, "customer_id", "left_semi") if known is not None else None
        folded = fold.customer_state_changes(batch, ["seq"], initial)
        path = f"{self.changes_path}/batch={batch_id}"
        folded.write.mode("overwrite").parquet(path)

        states = fold.latest_state(self._spark.read.schema(folded.schema).parquet(path), ["seq"])
        full = known is not None and batch_id % self._full_every == 0
        if full:
            states = states.unionByName(known.join(touched, "customer_id", "left_anti"))
        states.write.mode("overwrite").parquet(f"{self.states_path}/full={int(full)}/batch={batch_id}")
