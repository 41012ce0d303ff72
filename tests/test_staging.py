import pytest

from framesift.plans import staging


class Session:
    """As much of a session as the folder depends on."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.master, self.folder, self.conf = self, master, folder, self
        self.own = {}

    def getConf(self):
        return {"spark.checkpoint.dir": self.folder}

    def get(self, key, default=None):
        return self.own.get(key, default)

    def set(self, key, value):
        self.own[key] = value


def test_only_a_local_master_gets_a_folder_of_its_own():
    assert staging.shared_root(Session("spark://a:1", "hdfs://b/c/")) == "hdfs://b/c"
    session = Session("local[2]")
    assert staging.shared_root(session).startswith("file://") and staging.shared_root(session) == staging.shared_root(session)
    for master in ("yarn", "spark://a:1", "k8s://a"):
        with pytest.raises(ValueError):
            staging.shared_root(Session(master))
