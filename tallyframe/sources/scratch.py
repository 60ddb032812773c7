"""A folder that driver and executors share, for streams, their checkpoints and kept tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only on a single machine, where that may be unset, below one under /tmp."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "/tmp/checkpoints"
    return f"{where.rstrip('/')}/tallyframe-{uuid.uuid4().hex}"
