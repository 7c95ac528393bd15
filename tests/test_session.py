"""The checkpoint folder: shared on a cluster, temporary on a local master only."""

import pytest

from quayside.session import ensure_checkpoint_dir


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder, self.used = master, folder, None

    def getCheckpointDir(self):
        return self.used

    def getConf(self):
        return {"spark.checkpoint.dir": self.folder} if self.folder else {}

    def setCheckpointDir(self, folder):
        self.used = folder


class Session:
    def __init__(self, context):
        self.sparkContext = context


def test_shared_folder():
    local, cluster = Context("local[2]"), Context("spark://host:7077", "/shared/checkpoints")
    ensure_checkpoint_dir(Session(local))
    ensure_checkpoint_dir(Session(cluster))
    assert local.used and cluster.used == "/shared/checkpoints"
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session(Context("yarn")))
