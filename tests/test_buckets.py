"""Customers share calls of the state processor; states stay one per customer."""

import pandas as pd
import pyarrow as pa
import pytest

from tandem.operators import fold
from tandem.streaming import packed, state

COLUMNS = ["partition", "offset", "event_id", "customer_id", "event_type", "amount_cents", "event_ts_ms"]


class Held:
    """A map state that lives in the test."""

    def __init__(self):
        self.values, self.asked = {}, []

    def getMapState(self, name, key, value):
        return self

    def getValue(self, key):
        self.asked.append(key)
        return self.values.get(key)

    def updateValue(self, key, value):
        self.values[key] = value


def call(processor, events):
    """One call with the packed rows of a bucket, as Spark makes it."""
    table = pa.table({c: [e[n] for e in events] for n, c in enumerate(COLUMNS)})
    halves = [packed.pack_table(table.slice(0, 3)), packed.pack_table(table.slice(3))]
    return list(processor.handleInputRows((7,), iter([pd.DataFrame({packed.PACKED: halves})]), None))


@pytest.mark.parametrize("added", [(), (state.PEAK,)])
def test_one_call_folds_all_customers_of_a_bucket(added):
    processor, held = state.CustomerStateProcessor(with_before=True, added=added), Held()
    processor.init(held)
    first = [
        (0, 5, "e5", "b", fold.CANCELLED, 400, 15), (0, 1, "e1", "a", fold.CREATED, 100, 11), (0, 2, "e2", None, fold.CREATED, 7, 12),
        (0, 4, "e4", "a", fold.UPDATED, -300, 14), (0, 3, "e3", "b", fold.CREATED, 500, 13),
    ]
    held.values[("idle",)] = (9, 9, fold.CREATED, 9, 1)
    out = call(processor, first)
    assert len(out) == 1
    got = {r["event_id"]: (r["customer_id"], r["order_count"], r["total_cents"], r["is_new"], r["was_total_cents"]) for r in out[0].to_dict("records")}
    assert got == {
        "e1": ("a", 1, 100, True, 0), "e4": ("a", 1, 0, False, 100), "e2": (None, 1, 7, True, 0),
        "e3": ("b", 1, 500, True, 0), "e5": ("b", 0, 100, False, 500),
    }
    assert held.values[("a",)][:4] == (1, 0, fold.UPDATED, 14) and held.values[("b",)][:4] == (0, 100, fold.CANCELLED, 15)
    assert sorted(held.asked, key=str) == sorted([("a",), ("b",), (None,)], key=str) and held.values[("idle",)] == (9, 9, fold.CREATED, 9, 1)
    again = call(processor, [(0, 6, "e6", "a", fold.CREATED, 50, 16)])[0].to_dict("records")
    assert [(r["order_count"], r["total_cents"], r["is_new"], r["was_total_cents"]) for r in again] == [(2, 50, False, 0)]
