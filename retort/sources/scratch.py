"""A folder that the driver and all executors share, for tables written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one where that is unset and all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="retort-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"
