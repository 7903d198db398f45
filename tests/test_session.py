"""Session rules: shared checkpoint folder on clusters."""

from types import SimpleNamespace

import pytest

from riskweave.session import checkpoint_dir


def fake_session(master, conf_dir=None, current=None):
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: current, set_dirs=[])
    sc.setCheckpointDir = lambda d: sc.set_dirs.append(d)
    conf = SimpleNamespace(get=lambda key, default=None: conf_dir if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(sparkContext=sc, conf=conf), sc


def test_cluster_without_shared_folder_is_refused():
    spark, sc = fake_session("yarn")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(spark)
    assert sc.set_dirs == []


def test_configured_folder_is_used():
    spark, sc = fake_session("yarn", conf_dir="hdfs:///shared/ckpt")
    checkpoint_dir(spark)
    assert sc.set_dirs == ["hdfs:///shared/ckpt"]
    spark, sc = fake_session("yarn", current="hdfs:///already")
    assert checkpoint_dir(spark) == "hdfs:///already" and sc.set_dirs == []
