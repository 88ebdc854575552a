"""Scratch tables: where they lie, what they leave."""

import os

import pytest

from premia.sources import scratch


def test_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), scratch.settings(spark, {key: "7", "spark.premia.own": "x"}):
        assert spark.conf.get(key) == "7" and spark.conf.get("spark.premia.own") == "x"
        raise RuntimeError
    assert spark.conf.get(key) == before and spark.conf.get("spark.premia.own", None) is None


def test_written_and_discarded(spark):
    out = scratch.written(spark.range(10).repartition(3, "id"))
    files = out.inputFiles()
    assert out.count() == 10 and all(f.startswith(scratch.shared_dir(spark)) for f in files)
    scratch.discard(out)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)
