"""Results that must not depend on the number of slices, the size of a side, or the columns of a topic."""

from pyspark.sql import functions as F

from tandem import session
from tandem.operators import modes, savepoints
from tandem.operators.small import join_small
from tandem.sources import topics
from tandem.streaming import runtime
from tests.conftest import rows, slices


def test_each_slice_is_read_alone_and_in_order(spark):
    folder = session.run_dir(spark, "slices")
    table = spark.range(240).withColumnRenamed("id", "seq")
    seen = []
    for path in slices(table, "seq", f"{folder}/topic", 12):
        stream = runtime.stream_table(spark, path)
        runtime.run_batches(stream, lambda df, _: seen.append(sorted(r["seq"] for r in df.collect())), f"{folder}/checkpoint")
    assert len(seen) == 12
    assert [n for part in seen for n in part] == list(range(240))


def test_join_beyond_the_limit_takes_maps(spark):
    left = spark.createDataFrame([(1, {1: 2}), (1, None), (2, {3: 4})], "k int, m map<int,int>")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(join_small(left, right, ["k"], how, 1)) == rows(join_small(left, right, ["k"], how))


def test_broadcast_mode_signals_reach_both_apps(spark):
    pairs = spark.createDataFrame([(1, "a", "b")], "pair_id int, app1 string, app2 string")
    schema = "pair_id int, target_app_id string, signal_type string, timestamp bigint, offset bigint, trace_no bigint"
    signals = spark.createDataFrame([(1, "broadcast", "DEMOTE", 10, 1, 1), (1, "b", "PROMOTE", 20, 2, 2)], schema)
    got = {(r["app_id"], r["mode"], r["valid_from_ms"], r["valid_to_ms"]) for r in modes.mode_timeline(signals, pairs).collect()}
    assert got == {("a", "ACTIVE", 0, 10), ("a", "SHADOW", 10, None), ("b", "SHADOW", 0, 20), ("b", "ACTIVE", 20, None)}


def test_control_records_of_a_whole_topic_row(spark):
    schema = "topic string, partition int, offset bigint, timestamp timestamp, key string, value string"
    value = '{"signalType": "PROMOTE", "targetAppId": "b", "timestamp": 7}'
    raw = spark.createDataFrame([("t", 0, 1, None, "b", value)], schema)
    out = topics.decode_control_signals(raw)
    assert len(set(out.columns)) == len(out.columns)
    assert out.select("timestamp", "topic_timestamp", "offset").first().asDict() == {"timestamp": 7, "topic_timestamp": None, "offset": 1}


def test_equal_versions_give_one_whole_row(spark):
    schema = "savepoint_id string, changed_ms bigint, status string, kafka_offsets map<int,bigint>"
    versions = spark.createDataFrame([("s", 1, "FAILED", {0: 1}), ("s", 1, "COMPLETED", {0: 9})], schema)
    for order in (versions, versions.orderBy(F.desc("status"))):
        row = savepoints.current_status(order).first()
        assert (row["status"], row["kafka_offsets"]) == ("FAILED", {0: 1})
