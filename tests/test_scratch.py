"""The shared folder of intermediate tables."""

import os

import pytest

from lorebank.sources import scratch


class Cluster:
    """A session on a cluster, as far as folder() looks."""

    def __init__(self, at):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": at}, type("Context", (), {"master": "spark://host:7077"})


def test_folder_of_a_cluster_is_never_made_up():
    assert scratch.folder(Cluster("hdfs://shared/")) == "hdfs://shared"
    with pytest.raises(RuntimeError):
        scratch.folder(Cluster(None))


def test_written_and_cleaned(spark):
    at = scratch._mine(spark).removeprefix("file:").replace("//", "/")
    table = scratch.written(spark.range(5).withColumnRenamed("id", "x"), "five")
    assert table.count() == 5 and any(name.endswith("-five") for name in os.listdir(at))
    scratch.clean(spark)
    assert not os.path.exists(at)
