import pytest

from runlens.plans import session as SS


class _Conf(dict):
    def get(self, k, default=None):
        return super().get(k, default)

    def set(self, k, v):
        self[k] = v


class _SC:
    def __init__(self, master):
        self.master = master
        self.dirs = []

    def setCheckpointDir(self, d):
        self.dirs.append(d)


class _Spark:
    def __init__(self, master, conf=None):
        self.conf = _Conf(conf or {})
        self.sparkContext = _SC(master)


def test_checkpoint_dir_is_read_from_the_session():
    s = _Spark("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert SS.checkpoint_path(s, "tables/x") == "hdfs:///shared/ckpt/tables/x"
    assert s.sparkContext.dirs == ["hdfs:///shared/ckpt"]


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        SS.ensure_checkpoint_dir(_Spark("spark://master:7077"))
    local = _Spark("local[2]")
    d = SS.ensure_checkpoint_dir(local)
    assert local.conf.get("spark.checkpoint.dir") == d


def test_cluster_conf_sizes_partitions_from_input():
    c = SS.cluster_conf(100 * 1024 ** 4, total_cores=8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409_600  # 256 MB each, however many that makes
    small = SS.cluster_conf(10 * 1024 ** 3, total_cores=64)
    assert int(small["spark.sql.shuffle.partitions"]) == 192  # three per core beats 40 x 256 MB
    assert small["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(256 * 1024 * 1024)


def test_nothing_that_the_cluster_set_is_overridden():
    class Conf(_Conf):
        def isModifiable(self, k):
            return k.startswith("spark.sql.")

    s = _Spark("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    s.conf = Conf(s.conf)
    mine = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.session.timeZone": "Europe/Berlin", "spark.sql.shuffle.partitions": "999"}
    s.conf.update(mine)
    s.sparkContext.getConf = lambda: type("C", (), {"getAll": lambda self: list(mine.items())})()
    SS.fill_unset(s)
    assert {k: s.conf[k] for k in mine} == mine
    assert s.conf["spark.sql.adaptive.skewJoin.enabled"] == "true"                 # unset: filled in
    assert "spark.ui.enabled" not in s.conf and "spark.driver.memory" not in s.conf  # not for a running session to set
    assert s.sparkContext.master == "yarn"
