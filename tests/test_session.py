"""The checkpoint folder: set once, shared, and required where executors are on other machines."""

import pytest

from tabulant.session import cluster_conf, cut_lineage, ensure_checkpoint_dir


def test_one_folder_for_all_checkpoints(spark):
    first = ensure_checkpoint_dir(spark)
    for _ in range(3):
        assert cut_lineage(spark.range(5)).count() == 5
    assert ensure_checkpoint_dir(spark) == first == spark.sparkContext.getCheckpointDir()


def test_a_cluster_must_name_the_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077", "k8s://host"):
        Session.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(Session())


def test_cluster_settings_follow_the_cores():
    conf = cluster_conf(4000, target_partition_mb=128)
    assert conf["spark.sql.shuffle.partitions"] == "12000"
    assert conf["spark.sql.files.maxPartitionBytes"] == conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "128m"
    assert cluster_conf(8)["spark.sql.shuffle.partitions"] == "200"
