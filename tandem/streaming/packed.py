"""Rows on their way to a state processor, packed as Arrow tables: Spark hands over each single row as a Python tuple."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

PACKED = "packed"
# Rows that a task holds before it cuts them by key.
ROWS_PER_PACK = 200_000


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(frames: Iterable[pd.DataFrame]) -> pa.Table:
    """The packed rows of one key, as one table; a column that some packs lack is null there."""
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for frame in frames for p in frame[PACKED]], promote_options="permissive")


def ints(table: pa.Table, column: str, missing: int = 0) -> np.ndarray:
    """A column as BIGINT, ``missing`` where it has no value."""
    if column not in table.column_names:
        return np.full(table.num_rows, missing, np.int64)
    return pc.fill_null(table[column].cast(pa.int64()), missing).to_numpy()


def _cut(held: list[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    codes = np.zeros(table.num_rows, np.int64)
    for key in keys:
        encoded = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * len(encoded.dictionary) + encoded.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    rows = table.take(order)
    values = rows.drop_columns(list(keys)).combine_chunks()
    stops = [*starts[1:].tolist(), len(order)]
    packs = [pack_table(values.slice(a, b - a)) for a, b in zip(starts.tolist(), stops, strict=True)]
    first = rows.select(list(keys)).take(starts).combine_chunks()
    yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in first.columns], pa.array(packs, pa.binary())], [*keys, PACKED])


def pack(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and some 200,000 rows of a task: the keys, and the other columns of those rows as ``packed``."""
    columns = list(rows.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= ROWS_PER_PACK:
                yield from _cut(held, keys)
                held, count = [], 0
        if held:
            yield from _cut(held, keys)

    fields = [rows.schema[k] for k in keys]
    return rows.select(*keys, *[c for c in columns if c not in keys]).mapInArrow(cut, StructType([*fields, StructField(PACKED, BinaryType())]))
