"""Checkpoint folder lookup: session setting first, never a local folder on a cluster."""

import pytest

from ledgerlens.session import checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Session:
    def __init__(self, values):
        self.conf = _Conf(values)

    @property
    def sparkContext(self):  # like a Spark Connect session
        raise RuntimeError("no context")


def test_uses_the_session_setting():
    s = _Session({"spark.checkpoint.dir": "hdfs://shared/ckpt", "spark.master": "yarn"})
    assert checkpoint_dir(s) == "hdfs://shared/ckpt"


def test_cluster_without_setting_is_an_error():
    with pytest.raises(RuntimeError, match="shared"):
        checkpoint_dir(_Session({"spark.master": "yarn"}))


def test_local_without_setting_gets_a_scratch_folder():
    s = _Session({"spark.master": "local[2]"})
    path = checkpoint_dir(s)
    assert path and s.conf.get("spark.checkpoint.dir") == path
