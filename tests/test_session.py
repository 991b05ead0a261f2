"""The shared folder comes from the session; only a local session may make its own."""

from types import SimpleNamespace

import pytest

from tandem import session


def fake(master, conf_dir=None):
    seen = {}
    context = SimpleNamespace(
        master=master, getConf=lambda: SimpleNamespace(get=lambda key: conf_dir), getCheckpointDir=lambda: seen.get("dir"),
        setCheckpointDir=lambda path: seen.update(dir=path),
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: conf_dir)), seen


def test_named_folder_is_used():
    spark, seen = fake("spark://cluster", "hdfs:///shared/")
    assert session.shared_dir(spark) == "hdfs:///shared" and seen["dir"] == "hdfs:///shared/"
    assert session.run_dir(spark, "job").startswith("hdfs:///shared/job-")


def test_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.shared_dir(fake("spark://cluster")[0])


def test_local_session_makes_one():
    assert session.shared_dir(fake("local[2]")[0])


def test_intermediate_results_are_read_back(spark):
    rows = session.stored(spark.range(5).toDF("n"), "test-stored")
    assert sorted(r.n for r in rows.collect()) == list(range(5))
