from types import SimpleNamespace

import pytest

from loamline.session import RUNTIME_CONF, build_session, scratch_dir


def test_session_is_utc_with_adaptive_plans(spark):
    again = build_session("again")
    for key, value in RUNTIME_CONF.items():
        assert again.conf.get(key) == value


def session(master, shared):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: shared),
                           sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session("spark://host:7077", None), "x")
    assert scratch_dir(session("spark://host:7077", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert "loamline-" in scratch_dir(session("local[2]", None), "x")
