"""Tables that running jobs keep: the register of snapshots, and offsets read from the progress of streams."""

import time

import pytest
from pyspark.sql import functions as F

from tandem.operators import lag
from tandem.schemas import SAVEPOINT
from tandem.session import run_dir
from tandem.streaming import progress, runtime
from tandem.streaming.register import SavepointRegister


def test_register_appends_versions_and_reads_them_back(spark):
    register = SavepointRegister(spark, f"{run_dir(spark, 'test-register')}/savepoints")
    assert register.current().count() == 0 and not register.update_status("s1", "COMPLETED", 5)
    rows = [(f"s{n}", f"loc{n}", {0: n, 7: 100 + n}, "job", None, n, "IN_PROGRESS") for n in (1, 2, 3)]
    register.save(spark.createDataFrame(rows, SAVEPOINT))
    register.save(spark.createDataFrame([("o", "x", {}, "other", "t", 9, "COMPLETED")], SAVEPOINT), 10)
    assert register.latest_completed("job").count() == 0
    assert register.update_status("s1", "COMPLETED", 50) and register.update_status("s2", "COMPLETED", 60) and register.update_status("s3", "FAILED", 70)
    best = register.latest_completed("job").first()
    assert (best.savepoint_id, best.location, best.kafka_offsets, best.taken_at_ms) == ("s2", "loc2", {0: 2, 7: 102}, 2)
    # a late or repeated version changes nothing, a newer one does
    register.update_status("s2", "COMPLETED", 60)
    register.save(spark.createDataFrame(rows[1:2], SAVEPOINT), 55)
    assert register.find("s2").first().status == "COMPLETED"
    register.update_status("s2", "FAILED", 80)
    assert register.latest_completed("job").first().savepoint_id == "s1"
    assert sorted((r.savepoint_id, r.status) for r in register.current().collect()) == [("o", "COMPLETED"), ("s1", "COMPLETED"), ("s2", "FAILED"), ("s3", "FAILED")]
    with pytest.raises(ValueError):
        register.update_status("s1", "DONE", 1)
    with pytest.raises(Exception, match="unknown status"):
        register.save(spark.createDataFrame([("z", "x", {}, "job", "t", 9, "DONE")], SAVEPOINT))


def test_offsets_of_topic_and_file_sources():
    report = {"timestamp": "2024-01-01T00:00:01.500Z", "sources": [
        {"description": "KafkaV2[Subscribe[events]]", "endOffset": {"events": {"0": 5, "3": 9}}}, {"description": "k", "endOffset": '{"other": {"1": 2}}'},
        {"description": "files", "endOffset": {"logOffset": 4}}, {"description": "rate", "endOffset": 17}, {"description": "new", "endOffset": None},
    ]}
    at = 1704067201500
    assert progress.offset_rows(report, 7, "app1") == [
        (7, "app1", "events", 0, 5, at), (7, "app1", "events", 3, 9, at), (7, "app1", "other", 1, 2, at), (7, "app1", "files", 0, 5, at)
    ]


def test_lag_of_two_running_streams(spark):
    """Two copies read one folder; the second one stops after three files."""
    folder = run_dir(spark, "test-live")
    table = spark.range(500).withColumnRenamed("id", "seq")
    staged = runtime.stage(table.filter("seq < 300"), "seq", f"{folder}/topic", 3)
    listener = progress.OffsetListener(spark, f"{folder}/offsets", {"copy-1": (1, "app1"), "copy-2": (1, "app2")})
    spark.streams.addListener(listener)
    try:
        def run(name):
            stream = staged.stream(spark).writeStream.queryName(name).format("noop").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True)
            stream.start().awaitTermination()

        run("copy-1")
        run("copy-2")
        table.filter("seq >= 300").repartitionByRange(2, "seq").write.mode("append").parquet(staged.folder)
        run("copy-1")
        for _ in range(60):
            rows = progress.read_offsets(spark, f"{folder}/offsets")
            if rows.filter("group_id = 'app1' and offset = 5").count():
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    topic = rows.first().topic
    assert topic.startswith("FileStreamSource")
    end = rows.agg(F.max("observed_ms")).first()[0] // 1000 * 1000 + 1000
    ticks = spark.createDataFrame([(end - 3_600_000,), (end,)], "observed_ms bigint")
    lags = lag.partition_lag(progress.on_ticks(rows, 1000, ticks), topic).collect()
    assert [(r.observed_ms, r.app1_offset, r.app2_offset, r.lag) for r in lags] == [(end, 5, 3, 2)]
