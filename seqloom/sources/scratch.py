"""Where jobs put files that all executors and the driver must see."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A session of one machine that names none gets one of its
    own; on a cluster that is an error, as a folder of one machine is seen by no other."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="seqloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named
