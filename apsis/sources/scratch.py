"""The folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder of our own only where that is unset and Spark runs in one process,
    as in tests. A cluster must name a folder, since its machines share no local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file://" + os.path.join(tempfile.gettempdir(), "apsis-checkpoints")).rstrip("/")
